"""As-of and interval joins, truth over intervals, measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accuracy, joins, sequences, truth
from .base import EVENTS, HOUR, event_turns, query, r6, table, turns

# Spans: a user's event opens one that lasts until the next event, a quarter of an hour at most. Turns: every event, of up to twenty minutes.
_CAP, _STEP = HOUR // 4, HOUR // 12
_WIDTH = 4 * _STEP
_SPANS = f"""{EVENTS}, sp AS (
  SELECT speaker_id % 20 AS user_id, 'u' || (speaker_id % 40) AS name, t_start_ns AS s_start, least(t_start_ns + {_CAP}, coalesce(lead(t_start_ns) OVER (PARTITION BY speaker_id ORDER BY t_start_ns), t_start_ns + {_CAP})) AS s_end FROM ev
), tu AS (SELECT id, t_start_ns, t_start_ns + (id % 5) * {_STEP} AS t_end_ns FROM ev
), cut AS (SELECT id, t_start_ns, t_end_ns, user_id, name, s_start, greatest(s_start, t_start_ns) AS lo, least(s_end, t_end_ns) AS hi FROM tu JOIN sp ON s_start < t_end_ns AND t_start_ns < s_end AND s_start < s_end AND t_start_ns < t_end_ns
), mg AS (SELECT *, sum(nw) OVER (PARTITION BY id, user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN max(hi) OVER (PARTITION BY id, user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS nw FROM cut)
), u AS (SELECT id, user_id, run, min(lo) AS lo, max(hi) AS hi, any_value(t_start_ns) AS a, any_value(t_end_ns) AS b FROM mg GROUP BY id, user_id, run
), cov AS (SELECT id, user_id, sum(hi - lo) / any_value(b - a) AS frac FROM u GROUP BY id, user_id)"""


def _rounded(c, digits):
    """Rounded as the SQL's engine does it: the number times the power of ten, to the nearest whole, halves away from zero."""
    return F.round(F.col(c) * 10.0**digits) / 10.0**digits


def _spans(spark, sf):
    from pyspark.sql import Window as W

    e = event_turns(spark, sf)
    cap = F.col("t_start_ns") + _CAP
    end = F.least(cap, F.coalesce(F.lead("t_start_ns").over(W.partitionBy("speaker_id").orderBy("t_start_ns")), cap))
    spans = e.select((F.col("speaker_id") % 20).alias("user_id"), F.concat(F.lit("u"), F.col("speaker_id") % 40).alias("name"), F.col("t_start_ns").alias("s_start"), end.alias("s_end"))
    rows = e.select("id", "t_start_ns", (F.col("t_start_ns") + (F.col("id") % 5) * _STEP).alias("t_end_ns"))
    return rows, spans


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, epoch_us(l_shipdate) AS t FROM lineitem), o AS (SELECT o_orderkey, o_custkey % 100 AS k, epoch_us(o_orderdate) AS s FROM orders)
, d AS (SELECT k, s, max(o_orderkey) AS o FROM o GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_suppkey, t, d.o AS asof_order, d.s AS asof_time FROM l ASOF LEFT JOIN d ON l.l_suppkey % 100 = d.k AND l.t >= d.s""")
def asof_place(spark, sf):
    """The latest order at or before each shipment, per key."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"), (F.col("l_suppkey") % 100).alias("k"))
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("k"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("asof_time"), F.col("o_orderkey").alias("asof_order"))
    return joins.asof_join(l, o, ["k"], "t", "asof_time").drop("k")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey % 100 AS k, epoch_us(l_shipdate) AS t FROM lineitem), o AS (SELECT o_custkey % 100 AS k, epoch_us(o_orderdate) AS s, max(o_orderkey) AS o FROM orders GROUP BY ALL), d AS (SELECT *, s + 86400000000 * (1 + o % 3) AS e FROM o WHERE o % 4 <> 0)
SELECT l_orderkey, l_linenumber, CASE WHEN d.e > l.t THEN d.o END AS visit FROM l ASOF LEFT JOIN d ON l.k = d.k AND l.t >= d.s""")
def asof_visit(spark, sf):
    """The visit that covers an instant: the latest that began, if it has not ended."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"), (F.col("l_suppkey") % 100).alias("k"))
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("k"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("s"), F.col("o_orderkey").alias("visit")).groupBy("k", "s").agg(F.max("visit").alias("visit")).where("visit % 4 <> 0")
    o = o.withColumn("e", F.col("s") + F.lit(86_400_000_000).cast("long") * (1 + F.col("visit") % 3))
    return joins.asof_join(l, o, ["k"], "t", "s", "e").select("l_orderkey", "l_linenumber", "visit")


@query(f"WITH {_SPANS}, nm AS (SELECT id, user_id, arg_max(name, s_start) AS name FROM cut GROUP BY ALL) SELECT id, user_id, name, round(frac, 9) AS frac FROM cov JOIN nm USING (id, user_id)")
def interval_coverage(spark, sf):
    rows, spans = _spans(spark, sf)
    return truth.covered(rows, spans, _WIDTH).withColumn("frac", _rounded("frac", 9))


@query(f"""WITH {_SPANS}, p AS (SELECT id, count(*) AS n, max(user_id) AS u, max(frac) AS f FROM cov WHERE frac >= 0.2 GROUP BY id
), near AS (SELECT DISTINCT id FROM tu JOIN sp ON s_start < t_end_ns + 300000000000 AND t_start_ns - 300000000000 < s_end AND s_start < s_end)
SELECT tu.id, CASE WHEN n >= 2 THEN 'overlap' WHEN n = 1 AND f >= 0.8 THEN 'single' WHEN n = 1 THEN 'partial' WHEN near.id IS NOT NULL THEN 'nobody' ELSE 'unknown' END AS verdict,
       CASE WHEN n = 1 THEN u END AS user_id, CASE WHEN n = 1 THEN round(f, 6) END AS frac
FROM tu LEFT JOIN p USING (id) LEFT JOIN near USING (id)""")
def verdict_table(spark, sf):
    rows, spans = _spans(spark, sf)
    return truth.judged(rows, truth.summed(rows, spans, _WIDTH), truth.reached(rows, spans)).withColumn("frac", _rounded("frac", 6))


@query(f"""WITH {_SPANS}, e AS (SELECT id, any_value(a) AS a, any_value(b) AS b, t, sum(d) AS d FROM (SELECT id, a, b, lo AS t, 1 AS d FROM u UNION ALL SELECT id, a, b, hi, -1 FROM u) GROUP BY id, t
), dp AS (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY t) AS depth, lead(t) OVER (PARTITION BY id ORDER BY t) AS until FROM e)
SELECT id, round(coalesce(sum(until - t) FILTER (depth >= 2), 0) / any_value(b - a), 6) AS frac FROM dp GROUP BY id""")
def simultaneous_frac(spark, sf):
    rows, spans = _spans(spark, sf)
    return truth.summed(rows, spans, _WIDTH).select("id", _rounded("at_once", 6).alias("frac"))


@query(f"""WITH {EVENTS}, k AS (SELECT speaker_id % 30 AS user_id, CASE source WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 END AS label, count(*) AS n FROM ev GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label) AS p, sum(n) OVER (PARTITION BY user_id) AS t FROM k WHERE label IS NOT NULL)
SELECT user_id, label::BIGINT AS speaker_id, round(n / t, 6) AS agreement, t::BIGINT AS n, t >= 20 AND n / t >= 0.9 AS links FROM r WHERE p = 1""")
def dominant_label(spark, sf):
    e = event_turns(spark, sf).select((F.col("speaker_id") % 30).alias("user_id"), F.when(F.col("source") == "click", 1).when(F.col("source") == "view", 2).when(F.col("source") == "error", 3).cast("long").alias("speaker_id"))
    return truth.dominant_label(e).withColumn("agreement", r6("agreement"))


@query("""WITH j AS (SELECT toxic AS truth, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END AS said FROM labels
), c AS (SELECT truth, count(*) AS n, count(*) FILTER (said = truth) AS correct, count(*) FILTER (said <> truth) AS wrong, count(*) FILTER (said IS NULL) AS declined FROM j GROUP BY ALL
), p AS (SELECT *, correct / nullif(correct + wrong, 0) AS precision, correct / n AS recall FROM c)
SELECT truth AS truth_id, n, correct, wrong, declined, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(CASE WHEN 0.25 * precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) END, 0), 6) AS f_half FROM p""")
def label_precision_recall_fbeta(spark, sf):
    l = table(spark, sf, "labels")
    said = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    s = truth.identity_scores(l.select(F.col("toxic").alias("truth_id"), said.alias("labelled_id")))
    return s.withColumns({c: r6(c) for c in ("precision", "recall", "f_half")})


@query(f"""WITH {EVENTS}, t AS (SELECT day, count(*) AS k FROM ev GROUP BY day), c AS (SELECT day, sum(k) OVER (ORDER BY day) AS upto, sum(k) OVER () AS n FROM t
), x AS (SELECT *, greatest(1, least(n - 1, floor(n * 0.6 + 0.5))) AS target FROM c), y AS (SELECT *, coalesce(min(CASE WHEN upto >= target AND upto < n THEN upto END) OVER (), max(CASE WHEN upto <= target THEN upto END) OVER (), n) AS cut FROM x)
SELECT day, upto <= cut AS fit, count(*) AS n FROM ev JOIN y USING (day) GROUP BY ALL""")
def chronological_split(spark, sf):
    """The early 60 per cent of events by day, no day cut in two."""
    return truth.chronological_split(event_turns(spark, sf), "day").groupBy("day", "fit").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT source, CASE quality WHEN 1 THEN 'solid' WHEN 0 THEN 'shaky' END AS c FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(c) AS checked, count(*) FILTER (c = 'solid') AS solid, count(*) FILTER (c = 'shaky') AS shaky, round(count(*) FILTER (c = 'shaky') / nullif(count(c), 0), 6) AS shaky_share FROM s GROUP BY ALL""")
def shaky_share(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return accuracy.shaky_shares(d.withColumn("asr_confidence", F.when(F.col("quality") == 1, "solid").when(F.col("quality") == 0, "shaky")), ["source"]).withColumn("shaky_share", r6("shaky_share"))


@query()
def edit_rate_by_source(spark, sf):
    """Each answer measured as a correction of the turn before it, by session: words changed over words there."""
    t = joins.neighbours(turns(spark, sf), ["thread_id"], ["t_start_ns", "id"], ["text"])
    fixed = t.where("prev_text IS NOT NULL").select("session_id", F.col("prev_text").alias("original"), F.col("text").alias("corrected"), F.col("t_start_ns").alias("at_ns"))
    return accuracy.edit_rates(fixed, ["session_id"]).withColumn("edit_rate", r6("edit_rate"))


@query(f"""WITH {EVENTS}, e AS (SELECT speaker_id, t_start_ns AS at_ns, CASE WHEN id % 3 = 0 THEN 'stop' ELSE 'start' END AS edge FROM ev
), n AS (SELECT *, lead(at_ns) OVER (PARTITION BY speaker_id ORDER BY at_ns, edge DESC) AS nx FROM e)
SELECT speaker_id, at_ns AS t_start_ns, least(coalesce(nx, at_ns + 6 * {HOUR}), at_ns + 6 * {HOUR}) AS t_end_ns, coalesce(nx, at_ns + 6 * {HOUR} + 1) <= at_ns + 6 * {HOUR} AS closed FROM n WHERE edge = 'start' AND least(coalesce(nx, at_ns + 1), at_ns + 1) > at_ns""")
def speaking_spans(spark, sf):
    """Edges paired to spans; open ones close after six hours."""
    e = event_turns(spark, sf).select("speaker_id", F.col("t_start_ns").alias("at_ns"), F.when(F.col("id") % 3 == 0, "stop").otherwise("start").alias("edge"))
    return sequences.speaking_spans(e, ["speaker_id"], 6 * HOUR)


@query(f"""WITH {EVENTS}, a AS (SELECT speaker_id % 6 AS n, t_start_ns AS lo, t_end_ns AS hi FROM ev
), m AS (SELECT *, sum(nw) OVER (PARTITION BY n ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY n ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS nw FROM a)
), u AS (SELECT n, run, min(lo) AS lo, max(hi) AS hi FROM m GROUP BY ALL)
SELECT x.n AS name, y.n AS other, round(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo)) / 1e9, 3) AS seconds FROM u x JOIN u y ON x.n < y.n AND x.lo < y.hi AND y.lo < x.hi GROUP BY ALL""")
def roster_copresence(spark, sf):
    p = event_turns(spark, sf).select((F.col("speaker_id") % 6).alias("name"), F.col("t_start_ns").alias("joined_ns"), F.col("t_end_ns").alias("left_ns"))
    return joins.roster_copresence(p, HOUR // 4).withColumn("seconds", F.round("seconds", 3))


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, epoch_us(l_shipdate) * 1000 AS started_ns, CASE WHEN l_orderkey % 4 = 0 THEN l_suppkey % 7 END AS world_id FROM lineitem
), v AS (SELECT o_custkey % 50 AS world_id, epoch_us(o_orderdate) * 1000 AS s, CASE WHEN o_orderkey % 1000 <> 0 THEN epoch_us(o_orderdate) * 1000 + 86400000000000 * (1 + o_orderkey % 3) END AS e FROM orders
), i AS (SELECT started_ns, v.world_id, row_number() OVER (PARTITION BY started_ns ORDER BY s DESC, v.world_id DESC) AS k
  FROM (SELECT DISTINCT started_ns FROM t WHERE world_id IS NULL) d JOIN v ON s <= started_ns AND (e IS NULL OR e > started_ns))
SELECT id, t.started_ns, coalesce(t.world_id, i.world_id) AS world_id FROM t LEFT JOIN i ON t.started_ns = i.started_ns AND k = 1""")
def stamp_worlds(spark, sf):
    """Shipments as conversations, orders as visits: a world for those that have none."""
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    t = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ns("l_shipdate").alias("started_ns"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_suppkey") % 7).alias("world_id"))
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("world_id"), ns("o_orderdate").alias("t_start_ns"), F.when(F.col("o_orderkey") % 1000 != 0, ns("o_orderdate") + F.lit(86_400_000_000_000) * (1 + F.col("o_orderkey") % 3)).alias("t_end_ns"))
    return joins.stamp_worlds(t, o, 86_400_000_000_000)
