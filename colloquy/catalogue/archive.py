"""Scans, pages, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import DAY_NS, flatten_tombstones, resolve_speakers
from ..operators import graph, lifecycle, rollups, scans
from .base import EVENTS, HOUR, event_turns, query, table, turns, turns_sql

_FROM, _TO = 1_704_067_200_000_000_000 + 5 * DAY_NS, 1_704_067_200_000_000_000 + 20 * DAY_NS


@query(f"WITH {EVENTS} SELECT id, speaker_id, source, t_start_ns FROM ev WHERE source = 'click' AND speaker_id = 8 AND t_start_ns >= {_FROM} AND t_start_ns < {_TO}")
def segment_facet_filter(spark, sf):
    return scans.segment_filter(event_turns(spark, sf), scans.SegmentFilter(speaker=8, source="click", from_ns=_FROM, to_ns=_TO)).select("id", "speaker_id", "source", "t_start_ns")


@query("SELECT event_type AS source, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def facet_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT DISTINCT n_nationkey AS world_id, n_name AS world_name FROM nation), m AS (SELECT world_id::VARCHAR AS world_id FROM v WHERE contains(lower(world_name), 'an'))
SELECT * FROM m UNION ALL SELECT 'wrld_none' WHERE NOT EXISTS (SELECT 1 FROM m)""")
def world_facet(spark, sf):
    v = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("world_id"), F.col("n_name").alias("world_name"))
    return scans.world_facet(v, "AN")


@query("SELECT 'wrld_none' AS world_id")
def world_facet_without_match(spark, sf):
    """No match means an impossible place, so that filtering by it gives nothing."""
    v = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("world_id"), F.col("n_name").alias("world_name"))
    return scans.world_facet(v, "nowhere at all")


@query(f"WITH {EVENTS} SELECT id, t_start_ns FROM ev WHERE t_start_ns < {_TO} ORDER BY t_start_ns DESC, id DESC LIMIT 200")
def transcript_tail_page(spark, sf):
    """The newest page before an instant."""
    return scans.transcript_page(event_turns(spark, sf), 200, to_ns=_TO).select("id", "t_start_ns")


@query(f"WITH {EVENTS} SELECT id, t_start_ns FROM ev WHERE t_start_ns >= {_FROM} AND t_start_ns < {_TO} ORDER BY t_start_ns, id LIMIT 200")
def transcript_head_page(spark, sf):
    """The first page from an instant on."""
    return scans.transcript_page(event_turns(spark, sf), 200, from_ns=_FROM, to_ns=_TO).select("id", "t_start_ns")


@query(f"WITH {EVENTS} SELECT id, t_start_ns, true AS has_more FROM ev WHERE t_start_ns >= {_FROM} AND t_start_ns < {_TO} AND id <= 1000000 AND (t_start_ns, id) > ({_FROM + 2 * DAY_NS}, 1700) ORDER BY t_start_ns, id LIMIT 100")
def history_keyset_page(spark, sf):
    """A page after a cursor, within a snapshot."""
    return scans.history_page(event_turns(spark, sf), _FROM, _TO, 100, (_FROM + 2 * DAY_NS, 1700), 1_000_000).select("id", "t_start_ns", "has_more")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, text, CASE conv_id % 3 WHEN 0 THEN 'shaky' WHEN 1 THEN 'solid' END AS c, CASE WHEN turn % 4 = 1 THEN 'mismatch' END AS l FROM conversations)
SELECT id, concat_ws(',', CASE WHEN c = 'shaky' THEN 'shaky' END, l) AS reasons FROM t WHERE c = 'shaky' OR l IS NOT NULL""")
def review_inbox(spark, sf):
    t = turns(spark, sf).withColumns({"asr_confidence": F.when(F.col("thread_id") % 3 == 0, "shaky").when(F.col("thread_id") % 3 == 1, "solid"), "lang_via": F.when(F.col("id") % 1000 % 4 == 1, "mismatch")})
    return scans.review_inbox(t).select("id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {EVENTS}, r AS (SELECT id, speaker_id, row_number() OVER (PARTITION BY speaker_id ORDER BY floor((t_end_ns - t_start_ns) / 1e9) DESC, overlap_frac DESC, id)::INT AS place FROM ev WHERE id % 3 <> 0)
SELECT * FROM r WHERE place <= 3""")
def speaker_samples(spark, sf):
    e = event_turns(spark, sf).withColumns({"audio_path": F.when(F.col("id") % 3 != 0, "a.wav"), "match_score": F.col("overlap_frac")})
    return scans.speaker_samples(e).select("id", "speaker_id", "place")


@query(f"WITH {EVENTS} SELECT count(*) FILTER (source = 'error') AS n, coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (source = 'error'), 0)::BIGINT AS bytes, false AS is_everything FROM ev")
def delete_preview(spark, sf):
    return scans.delete_preview(event_turns(spark, sf).withColumn("bytes", F.round(F.col("value") * 100).cast("long")), scans.SegmentFilter(source="error"))


@query(f"""WITH {EVENTS}, s AS (SELECT id, day, speaker_id AS session, speaker_id * 100 + day // 7 AS thread, t_start_ns FROM ev), w AS (
  SELECT id, day IS DISTINCT FROM lag(day) OVER x AS new_day, thread IS DISTINCT FROM lag(thread) OVER x AND lag(id) OVER x IS NOT NULL AS new_thread FROM s WINDOW x AS (PARTITION BY session ORDER BY t_start_ns, id))
SELECT * FROM w""")
def separators(spark, sf):
    e = event_turns(spark, sf).withColumns({"session_id": F.col("speaker_id"), "thread_id": F.expr("speaker_id * 100 + day div 7")})
    return scans.separators(e).select("id", "new_day", "new_thread")


@query(f"""WITH {turns_sql()}, p AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY t_start_ns, id) AS n FROM turns
), m AS (SELECT id % 37 AS moment_id, id AS segment_id FROM turns WHERE id % 1000 < 3)
SELECT moment_id, count(*) AS n, coalesce(max(p.n) - min(p.n) + 1 = count(*) AND count(DISTINCT session_id) = 1, false) AS contiguous FROM m JOIN p ON p.id = segment_id GROUP BY ALL""")
def contiguous_moments(spark, sf):
    t = turns(spark, sf)
    return scans.contiguous_moments(t, t.where("id % 1000 < 3").select((F.col("id") % 37).alias("moment_id"), F.col("id").alias("segment_id")))


@query("""WITH RECURSIVE s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 AND c_custkey > 0 THEN c_custkey // 10 END AS merged_into FROM customer
), f AS (SELECT id, coalesce(merged_into, id) AS goal, 0 AS k FROM s UNION ALL SELECT f.id, s.merged_into, k + 1 FROM f JOIN s ON s.id = f.goal WHERE s.merged_into IS NOT NULL)
SELECT id, min(goal) AS canonical_id FROM f GROUP BY id""")
def tombstone_resolve(spark, sf):
    """Chains of merges followed to their end."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when((F.col("c_custkey") % 10 == 0) & (F.col("c_custkey") > 0), F.expr("c_custkey div 10")).alias("merged_into"))
    return flatten_tombstones(c)


@query(f"WITH {EVENTS} SELECT CASE WHEN speaker_id % 10 = 0 THEN speaker_id // 10 ELSE speaker_id END AS speaker_id, count(*) AS n FROM ev GROUP BY ALL")
def resolved_counts(spark, sf):
    e = event_turns(spark, sf)
    s = e.select(F.col("speaker_id").alias("id")).distinct().withColumn("merged_into", F.when(F.col("id") % 10 == 0, F.expr("id div 10")))
    return resolve_speakers(e, s).groupBy("speaker_id").agg(F.count(F.lit(1)).alias("n"))


_NOW = 1_704_067_200_000_000_000 + 31 * DAY_NS
_FATE = f"""fates AS (SELECT *, CASE WHEN deleted_at <= {_NOW - 7 * DAY_NS} THEN 'purge' WHEN t_end_ns <= {_NOW - 10 * DAY_NS} AND text IS NULL AND who IS NULL THEN 'purge_empty' WHEN t_end_ns <= {_NOW - 10 * DAY_NS} THEN 'forget_audio' ELSE 'keep' END AS fate
  FROM (SELECT id, t_end_ns, day, CASE WHEN id % 5 = 0 THEN t_start_ns + {DAY_NS} END AS deleted_at, CASE WHEN id % 3 <> 0 THEN source END AS text, CASE WHEN id % 2 = 0 THEN speaker_id END AS who FROM ev))"""


def _retained(spark, sf):
    e = event_turns(spark, sf)
    e = e.withColumns({"deleted_at": F.when(F.col("id") % 5 == 0, F.col("t_start_ns") + DAY_NS), "text": F.when(F.col("id") % 3 != 0, F.col("source")), "speaker_id": F.when(F.col("id") % 2 == 0, F.col("speaker_id")), "audio_path": F.lit("a.wav"), "thread_id": F.col("day")})
    return lifecycle.retention(e, _NOW, undo_days=7, audio_days=10)


@query(f"WITH {EVENTS}, {_FATE} SELECT fate, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM fates GROUP BY ALL")
def retention_sweep(spark, sf):
    return _retained(spark, sf).groupBy("fate").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"""WITH {EVENTS}, {_FATE}, t AS (SELECT day, count(*) FILTER (fate NOT LIKE 'purge%') AS l FROM fates GROUP BY day)
SELECT count(*) FILTER (fate = 'purge') AS purged_rows, count(*) FILTER (fate = 'purge_empty') AS purged_empty, count(*) FILTER (fate = 'forget_audio') AS aged_audio, count(*) FILTER (fate = 'keep') AS kept,
       (SELECT count(*) FROM t WHERE l = 0) AS pruned_threads FROM fates""")
def retention_report(spark, sf):
    return lifecycle.retention_report(_retained(spark, sf))


@query(f"""WITH {EVENTS}, l AS (SELECT speaker_id AS segment_id, id AS op_id, t_start_ns AS at_ns, source AS prior_text FROM ev WHERE id % 2 = 0)
SELECT segment_id, prior_text AS original, coalesce(lead(prior_text) OVER (PARTITION BY segment_id ORDER BY at_ns, op_id), 'now') AS corrected, at_ns FROM l""")
def correction_chain(spark, sf):
    """What each correction replaced and by what: the next one's prior text, or the row as it stands."""
    from ..operators import accuracy

    e = event_turns(spark, sf)
    prior = F.to_json(F.struct(F.col("speaker_id").alias("segment_id"), F.col("source").alias("text")))
    ops = e.select("id", F.lit("correct_text").alias("op"), F.when(F.col("id") % 2 == 0, prior).otherwise(F.lit("{not json")).alias("prior_state"), F.col("t_start_ns").alias("at_utc_ns"))
    current = e.select(F.col("speaker_id").alias("segment_id")).distinct().withColumn("text", F.lit("now"))
    return accuracy.corrections(accuracy.correction_log(ops), current)


@query(f"""WITH {EVENTS}, s AS (SELECT speaker_id AS segment_id, t_start_ns AS at_ns, source AS text, CASE WHEN id % 3 = 0 THEN 'shaky' ELSE 'solid' END AS c FROM ev
), w AS (SELECT *, c = 'shaky' AS needs, row_number() OVER x = 1 OR text IS DISTINCT FROM lag(text) OVER x OR c IS DISTINCT FROM lag(c) OVER x AS changed, max((c = 'shaky')::INT) OVER (PARTITION BY segment_id ORDER BY at_ns ROWS UNBOUNDED PRECEDING) = 1 AS entered FROM s WINDOW x AS (PARTITION BY segment_id ORDER BY at_ns))
SELECT segment_id, count(*) AS revision, arg_max(needs, at_ns) AS pending FROM w WHERE entered AND changed GROUP BY ALL""")
def review_revisions(spark, sf):
    """The review queue as a view over a log of states."""
    e = event_turns(spark, sf).select(F.col("speaker_id").alias("segment_id"), F.col("t_start_ns").alias("at_ns"), F.col("source").alias("text"), F.when(F.col("id") % 3 == 0, "shaky").otherwise("solid").alias("asr_confidence"), F.lit(None).cast("string").alias("lang_via"), F.lit(None).cast("long").alias("deleted_at"))
    return lifecycle.review_revisions(e)


@query(f"""WITH {EVENTS}, s AS (SELECT speaker_id AS id, t_start_ns AS at_ns, CASE source WHEN 'click' THEN 'done' WHEN 'view' THEN 'reopened' WHEN 'error' THEN 'dropped' WHEN 'signup' THEN 'open' ELSE 'snoozed' END AS event, CAST(round(value * 100) AS BIGINT) * 20000000000 AS arg FROM ev)
SELECT id, arg_max(CASE event WHEN 'reopened' THEN 'open' ELSE event END, at_ns) FILTER (event <> 'snoozed') AS state, arg_max(at_ns + least({7 * DAY_NS}, greatest(60000000000, arg)), at_ns) FILTER (event = 'snoozed') AS due_ns FROM s GROUP BY id""")
def commitment_states(spark, sf):
    """Latest states, and due times moved by snoozes held within their bounds."""
    kind = F.when(F.col("source") == "click", "done").when(F.col("source") == "view", "reopened").when(F.col("source") == "error", "dropped").when(F.col("source") == "signup", "open").otherwise("snoozed")
    e = event_turns(spark, sf).select(F.col("speaker_id").alias("id"), F.col("t_start_ns").alias("at_ns"), kind.alias("event"), (F.round(F.col("value") * 100).cast("long") * 20_000_000_000).alias("arg"))
    return lifecycle.states(e)


@query("""SELECT count(*) AS eligible, count(*) FILTER (conv_id % 2 = 0) AS embedded, count(*) FILTER (conv_id % 2 <> 0) AS pending FROM conversations""")
def index_coverage(spark, sf):
    t = turns(spark, sf)
    return rollups.index_coverage(t, t.where("thread_id % 2 = 0").select(F.col("id").alias("segment_id")))


@query("""SELECT conv_id * 1000 + turn AS id, length(text) AS n FROM conversations WHERE conv_id % 3 <> 0 OR turn % 2 = 0""")
def stale_vectors(spark, sf):
    """Texts without a vector for what they say now: some have none, some have one of older words."""
    t = turns(spark, sf)
    old = t.where("thread_id % 3 = 0").select(F.col("id").alias("segment_id"), F.xxhash64(F.when(F.col("id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("text_hash"), F.lit("m").alias("model_id"))
    return lifecycle.stale_vectors(t, old, "m").select("id", F.char_length("text").cast("long").alias("n"))


@query(f"""WITH {EVENTS}, a AS (SELECT id, t_start_ns FROM ev WHERE source = 'click' ORDER BY t_start_ns, id LIMIT 64), b AS (SELECT id, t_start_ns FROM ev WHERE speaker_id = 8 ORDER BY t_start_ns, id LIMIT 64)
SELECT DISTINCT id, t_start_ns FROM (SELECT * FROM a UNION SELECT * FROM b) ORDER BY t_start_ns, id LIMIT 64""")
def repair_candidates(spark, sf):
    """Two bounded branches of a work list, united."""
    e = event_turns(spark, sf)
    order = [F.col("t_start_ns"), F.col("id")]
    return graph.bounded_union(e.where("source = 'click'").select("id", "t_start_ns"), e.where("speaker_id = 8").select("id", "t_start_ns"), limit=64, order=order)


@query(f"""WITH {EVENTS}, n AS (SELECT id, t_start_ns, row_number() OVER (ORDER BY t_start_ns, id) - 1 AS k, count(*) OVER () AS n FROM ev), p AS (SELECT DISTINCT i * (n - 1) // 99 AS k FROM range(100) t(i), (SELECT max(n) AS n FROM n))
SELECT id, t_start_ns FROM n JOIN p USING (k)""")
def strided_sample(spark, sf):
    """A hundred rows evenly from first to last."""
    return rollups.strided_sample(event_turns(spark, sf).select("id", "t_start_ns"), ["t_start_ns", "id"], 100)


@query(f"""WITH {EVENTS}, b AS (SELECT DISTINCT day, source, (t_start_ns // {HOUR}) AS bucket FROM ev)
SELECT DISTINCT i.day, 'view' AS stream, i.source AS instance, round(count(*) FILTER (EXISTS (SELECT 1 FROM b s WHERE s.source = 'view' AND s.day = i.day AND s.bucket BETWEEN i.bucket - 1 AND i.bucket + 1)) OVER (PARTITION BY i.day, i.source) / count(*) OVER (PARTITION BY i.day, i.source), 6) AS share
FROM b i WHERE i.source = 'click'
QUALIFY share >= 0.5""")
def client_bridge(spark, sf):
    """Which activity a stream carries, day by day: hours of one within an hour of the other's."""
    e = event_turns(spark, sf).where("source IN ('view', 'click')")
    active = e.select("day", F.when(F.col("source") == "view", "stream").otherwise("instance").alias("kind"), F.col("source").alias("name"), F.expr(f"t_start_ns div {HOUR}").alias("bucket"))
    return graph.client_bridge(active, ["day"], slack=1, share=0.5, clear=0.0, least=1).withColumn("share", F.round("share", 6))
