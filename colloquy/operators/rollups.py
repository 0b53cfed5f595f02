"""Rollups: persons, worlds, topics, gaps, moods, quantiles, review evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import NS, ratio
from .talk import speech

MOOD_MIN_ROWS, LAUGHS_SHARE, PRUNE_MAX_SEGMENTS, PRUNE_MAX_S = 30, 0.05, 1, 3.0
GAP_CAUSES = ("flap", "queue_overflow", "scheduler_starvation", "pipewire_xrun", "session_end", "unexplained")


def person_totals(turns: DataFrame) -> DataFrame:
    """speaker_id, segments, speech_ns, sessions, threads, first_ns, last_ns."""
    return turns.where("speaker_id IS NOT NULL").groupBy("speaker_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(speech()).alias("speech_ns"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("thread_id").alias("threads"), F.min("t_start_ns").alias("first_ns"), F.max("t_end_ns").alias("last_ns")
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    return df.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def worlds_list(visits: DataFrame) -> DataFrame:
    """world_id, name (the newest known), visits, last_ns."""
    return visits.groupBy("world_id").agg(F.max_by("world_name", F.when(F.col("world_name").isNotNull(), F.struct("t_start_ns", "world_name"))).alias("name"), F.count(F.lit(1)).alias("visits"), F.max("t_start_ns").alias("last_ns"))


def world_people(threads: DataFrame, turns: DataFrame, limit: int = 5) -> DataFrame:
    """world_id, speaker_id, spoke_ns, place: the voices heard most in each world, ties to the smaller id.

    Speech is summed by conversation first, so a world with most of the turns joins sums, not turns.
    """
    spoke = turns.where("speaker_id IS NOT NULL").groupBy("thread_id", "speaker_id").agg(F.sum(F.col("t_end_ns") - F.col("t_start_ns")).alias("ns"))
    per = spoke.join(threads.where("world_id IS NOT NULL").select(F.col("id").alias("thread_id"), "world_id"), "thread_id").groupBy("world_id", "speaker_id").agg(F.sum("ns").alias("spoke_ns"))
    return top_per_group(per, ["world_id"], [F.col("spoke_ns").desc(), F.col("speaker_id")], limit)


def world_topics(threads: DataFrame, limit: int = 5) -> DataFrame:
    """world_id, topic, threads, place: what is talked about most in each world; blank topics don't count, ties by name."""
    per = threads.where("world_id IS NOT NULL AND trim(topic) <> ''").groupBy("world_id", "topic").agg(F.count(F.lit(1)).alias("threads"))
    return top_per_group(per, ["world_id"], [F.col("threads").desc(), F.col("topic")], limit)


def worlds_page(visits: DataFrame, threads: DataFrame, turns: DataFrame, people: int = 5, topics: int = 5) -> DataFrame:
    """``worlds_list`` with ``people`` (ids) and ``topics``, the first first; empty where nothing was heard. ``turns`` are live, their voices resolved."""

    def listed(rows: DataFrame, what: str, name: str) -> DataFrame:
        return rows.groupBy("world_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", what))), lambda x: x[what]).alias(name))

    out = worlds_list(visits).join(listed(world_people(threads, turns, people), "speaker_id", "people"), "world_id", "left")
    out = out.join(listed(world_topics(threads, topics), "topic", "topics"), "world_id", "left")
    return out.withColumns({"people": F.coalesce("people", F.array().cast("array<bigint>")), "topics": F.coalesce("topics", F.array().cast("array<string>"))})


def person_worlds(threads: DataFrame, turns: DataFrame, visits: DataFrame, limit: int = 8) -> DataFrame:
    """speaker_id, world_id, visits, last_ns, together_ns: where each voice's conversations were, longest first.

    A conversation's visit is the latest of its world that began no later.
    """
    from .joins import asof_join

    took_part = turns.where("speaker_id IS NOT NULL").select("thread_id", "speaker_id").distinct()
    placed = asof_join(threads.where("world_id IS NOT NULL").select(F.col("id").alias("thread_id"), "world_id", "started_ns", "ended_ns"), visits.select("world_id", F.col("id").alias("visit_id"), "t_start_ns"), ["world_id"], "started_ns", "t_start_ns")
    rows = took_part.join(placed, "thread_id").groupBy("speaker_id", "world_id").agg(F.countDistinct("visit_id").alias("visits"), F.max("ended_ns").alias("last_ns"), F.sum(F.greatest(F.lit(0), F.col("ended_ns") - F.col("started_ns"))).alias("together_ns"))
    return top_per_group(rows, ["speaker_id"], [F.col("together_ns").desc(), F.col("last_ns").desc(), F.col("world_id")], limit)


def topic_list(threads: DataFrame, keep_ids: int = 5) -> DataFrame:
    """topic, threads, segments, last_ns, thread_ids: the newest ``keep_ids`` threads of each topic.

    Ids are numbered within a topic before they are gathered, so no list grows with a topic.
    """
    per = threads.where("topic IS NOT NULL").groupBy("topic").agg(F.count(F.lit(1)).alias("threads"), F.sum("segments").alias("segments"), F.max("ended_ns").alias("last_ns"))
    newest = top_per_group(threads.where("topic IS NOT NULL").select("topic", "id", "ended_ns"), ["topic"], [F.col("ended_ns").desc(), F.col("id").desc()], keep_ids)
    ids = newest.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("thread_ids"))
    return per.join(ids, "topic")


def graph_summary(threads: DataFrame) -> DataFrame:
    """threads, with_topic, enriched, waiting, too_short, pending: waiting and too short together are pending."""
    todo = F.col("enriched_ns").isNull()
    short = F.col("segments") < 3
    return threads.agg(F.count(F.lit(1)).alias("threads"), F.count_if(F.col("topic").isNotNull()).alias("with_topic"), F.count_if(~todo).alias("enriched"), F.count_if(todo & ~short).alias("waiting"), F.count_if(todo & short).alias("too_short"), F.count_if(todo).alias("pending"))


def gap_health(gaps: DataFrame, unexplained: str = "unexplained") -> DataFrame:
    """hour, cause, n, gap_ms, unexplained_share (of the hour's gaps)."""
    per = gaps.groupBy(F.date_trunc("hour", F.col("at")).alias("hour"), "cause").agg(F.count(F.lit(1)).alias("n"), F.sum("gap_ms").alias("gap_ms"))
    hour = W.partitionBy("hour")
    return per.withColumn("unexplained_share", ratio(F.sum(F.when(F.col("cause") == unexplained, F.col("n")).otherwise(0)).over(hour), F.sum("n").over(hour)))


def classify_gap(flapped: Column, evicted: Column, xruns: Column, silent_ms: Column, stalled_ms: Column, min_silence_ms: int = 500) -> Column:
    """The cause of a gap from its evidence: a reconnect; buffers evicted since the last chunk; the graph's own count; silence before the end; a stall without eviction."""
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    return (
        F.when(F.coalesce(flapped, F.lit(False)), "flap")
        .when(some(evicted), "queue_overflow")
        .when(some(xruns), "pipewire_xrun")
        .when(F.coalesce(silent_ms, F.lit(0)) >= min_silence_ms, "session_end")
        .when(some(stalled_ms), "scheduler_starvation")
        .otherwise("unexplained")
    )


def speaker_source_matrix(turns: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Turns of each voice by source, a column a source (fixed if given, so that no pass is needed to find them)."""
    return turns.where("speaker_id IS NOT NULL").groupBy("speaker_id").pivot("source", sources).agg(F.count(F.lit(1))).na.fill(0)


def index_coverage(turns: DataFrame, vectors: DataFrame) -> DataFrame:
    """eligible, embedded, pending of a vector index."""
    from ..core import blank, live

    rows = live(turns).where(~blank(F.col("text"))).select("id")
    have = vectors.select(F.col("segment_id").alias("id")).distinct().withColumn("x", F.lit(1))
    joined = rows.join(have, "id", "left")
    return joined.agg(F.count(F.lit(1)).alias("eligible"), F.count("x").alias("embedded")).withColumn("pending", F.greatest(F.lit(0), F.col("eligible") - F.col("embedded")))


def prune_candidates(turns: DataFrame) -> DataFrame:
    """Voices with hardly any evidence: one segment at most, of three seconds at most."""
    return person_totals(turns).where((F.col("segments") <= PRUNE_MAX_SEGMENTS) & (F.col("speech_ns") <= int(PRUNE_MAX_S * NS)))


def onboarding_candidates(turns: DataFrame, speakers: DataFrame, you: int | None = None, limit: int = 3, share: float = 0.25) -> DataFrame:
    """Voices without a name that have a quarter of the unnamed speech or more; ``you`` counts nowhere."""
    rows = turns if you is None else turns.where(F.col("speaker_id") != you)
    unnamed = speakers.where("display_name IS NULL").select(F.col("id").alias("speaker_id"))
    per = rows.join(unnamed, "speaker_id", "left_semi").groupBy("speaker_id").agg(F.sum(speech()).alias("speech_ns"))
    return per.withColumn("share", ratio(F.col("speech_ns"), F.sum("speech_ns").over(W.partitionBy()))).where(F.col("share") >= share).orderBy(F.col("speech_ns").desc(), "speaker_id").limit(limit)


def mood_summary(turns: DataFrame, key: str = "speaker_id") -> DataFrame:
    """key, rows, laugh_share, laughs, top_mood: null below 30 rows, which is not zero."""
    enough = F.col("rows") >= MOOD_MIN_ROWS
    rated = turns.where("mood_at_ns IS NOT NULL")
    per = rated.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.array_contains("events", "laughter")).alias("k"))
    moods = rated.where("mood IS NOT NULL").groupBy(key, "mood").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max_by("mood", F.struct("n", "mood")).alias("top_mood"))
    share = F.when(enough, F.col("k") / F.col("rows"))
    return per.join(moods, key, "left").select(key, "rows", share.alias("laugh_share"), (share >= LAUGHS_SHARE).alias("laughs"), F.when(enough, F.col("top_mood")).alias("top_mood"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], rule: str = "round") -> DataFrame:
    """Quantiles that are values of the data: at round((n - 1) p), or (``ceil``) at ceil(n p) - 1, of the ascending values.

    Equal values are counted, so what is ordered within a key is its distinct values.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__k"))
    w = W.partitionBy(*keys).orderBy(value)
    rows = per.withColumn("__upto", F.sum("__k").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.sum("__k").over(W.partitionBy(*keys)))
    at = lambda p: F.floor((F.col("__n") - 1) * p + 0.5) if rule == "round" else F.greatest(F.lit(0), F.ceil(F.col("__n") * p) - 1)
    picks = [F.min(F.when(F.col("__upto") > at(p), F.col(value))).alias(name) for name, p in quantiles.items()]
    return rows.groupBy(*keys).agg(F.first("__n").alias("n"), *picks)


def performance_stats(samples: DataFrame, keys: list[str], ring: int = 512) -> DataFrame:
    """n, latest, p50, p95, max over the newest ``ring`` samples (at_ns, ms) of each key."""
    kept = top_per_group(samples, keys, [F.col("at_ns").desc()], ring)
    q = nearest_rank(kept, keys, "ms", {"p50": 0.5, "p95": 0.95}, "ceil")
    return q.join(kept.groupBy(*keys).agg(F.max_by("ms", "at_ns").alias("latest"), F.max("ms").alias("max")), keys)


def strided_sample(df: DataFrame, order: list[str], count: int) -> DataFrame:
    """``count`` rows evenly strided from first to last in order: pick i is row i (n - 1) div (count - 1); all rows if there are fewer.

    Numbers come from per-partition counts after a range sort, not from one window over all rows.
    """
    from .paging import numbered

    rows, n = numbered(df, order)
    if n <= count:
        return rows.drop("row_no")
    picks = df.sparkSession.range(count).select(F.expr(f"id * {n - 1} div {max(1, count - 1)}").alias("row_no")).distinct()
    return rows.join(F.broadcast(picks), "row_no", "left_semi").drop("row_no")
