"""Measurement of recognition: corrections, edit rates, shaky shares, retrieval quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import ratio
from ..functions.text import edits


def correction_log(operations: DataFrame, op: str = "correct_text") -> DataFrame:
    """(segment_id, prior_text, at_ns) of the operations log; malformed or textless prior states are skipped."""
    prior = F.try_parse_json("prior_state")
    rows = operations.where(F.col("op") == op).select(F.try_variant_get(prior, "$.segment_id", "bigint").alias("segment_id"), F.try_variant_get(prior, "$.text", "string").alias("prior_text"), F.col("at_utc_ns").alias("at_ns"), F.col("id").alias("op_id"))
    return rows.where("segment_id IS NOT NULL AND prior_text IS NOT NULL")


def corrections(log: DataFrame, current: DataFrame) -> DataFrame:
    """(segment_id, original, corrected, at_ns): what each correction replaced, and by what.

    A correction's result is the next one's prior text, the last one's the row as
    it stands (``current``: segment_id, text); a row that is gone leaves nothing.
    """
    w = W.partitionBy("segment_id").orderBy("at_ns", "op_id")
    nxt = F.lead("prior_text").over(w)
    last = F.lead(F.lit(True)).over(w).isNull()
    rows = log.withColumn("__next", nxt).withColumn("__last", last).join(current.select("segment_id", F.col("text").alias("__now")), "segment_id", "left")
    return rows.select("segment_id", F.col("prior_text").alias("original"), F.when(F.col("__last"), F.coalesce("__now", F.lit(""))).otherwise(F.col("__next")).alias("corrected"), "at_ns")


def edit_rates(fixed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, corrections, edit_rate, since_ns of rows (original, corrected, at_ns, keys): edits over words, summed before dividing."""
    rows = fixed.withColumn("e", edits(F.col("original"), F.col("corrected"))).where("e IS NOT NULL")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("corrections"), ratio(F.sum("e.edits"), F.sum("e.words")).alias("edit_rate"), F.min("at_ns").alias("since_ns"))


def shaky_shares(turns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, checked, solid, shaky, shaky_share: null where nothing was checked."""
    solid, shaky = F.count_if(F.col("asr_confidence") == "solid"), F.count_if(F.col("asr_confidence") == "shaky")
    rows = turns.groupBy(*keys).agg(solid.alias("solid"), shaky.alias("shaky")).withColumn("checked", F.col("solid") + F.col("shaky"))
    return rows.select(*keys, "checked", "solid", "shaky", ratio(F.col("shaky"), F.col("checked")).alias("shaky_share"))


def accuracy_summary(fixed: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """Both halves by ``key``, a facet as it is now; most evidence first by (corrections, checked, key)."""
    both = edit_rates(fixed, [key]).join(shaky_shares(turns, [key]), key, "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(key, zero("corrections"), "edit_rate", "since_ns", zero("checked"), zero("solid"), zero("shaky"), "shaky_share")


def evidence_order(rows: DataFrame, key: str) -> DataFrame:
    return rows.orderBy(F.col("corrections").desc(), F.col("checked").desc(), F.col(key))


def outcomes(ranked: DataFrame, items: DataFrame, thread_of: DataFrame) -> DataFrame:
    """(item_id, exact_rank, thread_rank): where the target, and the first of its thread, stand in each item's ranked ids.

    ``ranked``: item_id, id, rank; ``items``: item_id, target_id, target_thread; ``thread_of``: id, thread_id.
    """
    rows = ranked.join(thread_of, "id", "left").join(items, "item_id")
    found = rows.groupBy("item_id").agg(F.min(F.when(F.col("id") == F.col("target_id"), F.col("rank"))).alias("exact_rank"), F.min(F.when(F.col("thread_id") == F.col("target_thread"), F.col("rank"))).alias("t"))
    return items.join(found, "item_id", "left").select(*items.columns, "exact_rank", F.least("exact_rank", "t").alias("thread_rank"))


def search_metrics(scored: DataFrame, keys: Sequence[str] = (), ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """keys, n, recall at each k and mean reciprocal rank, exact and by thread; a target not found has reciprocal rank 0."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for kind in ("exact", "thread"):
        rank = F.col(f"{kind}_rank")
        aggs += [F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0))).alias(f"recall{k}_{kind}") for k in ks]
        aggs.append(F.avg(F.coalesce(1 / rank, F.lit(0.0))).alias(f"mrr_{kind}"))
    return scored.groupBy(*keys).agg(*aggs)


def decoder_rules(readings: DataFrame, min_rows: int = 30, min_held: int = 12, gain: float = 0.02) -> DataFrame:
    """Which decoder to believe in each cell (source_kind, speaker_id, length), learnt on the early part, checked on the late.

    ``readings``: source_kind, speaker_id, seconds, at_ns, live_edits, live_words,
    night_edits, night_words. A cell needs ``min_rows`` rows and ``min_held`` held-out
    ones; the other reading must be ``gain`` better on both; else the cell inherits.
    """
    from .truth import chronological_split

    length = F.when(F.col("seconds") < 2, "short").when(F.col("seconds") < 6, "medium").otherwise("long")
    rows = chronological_split(readings.withColumn("length", length), "at_ns")
    cells = rows.rollup("source_kind", "speaker_id", "length").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("fit")).alias("held"),
        *(ratio(F.sum(F.when(F.col("fit") == fit, F.col(f"{who}_edits"))), F.sum(F.when(F.col("fit") == fit, F.col(f"{who}_words")))).alias(f"{who}_{part}") for who in ("live", "night") for fit, part in ((True, "fit"), (False, "late"))),
    )
    better = (F.col("live_fit") - F.col("night_fit") >= gain) & (F.col("live_late") - F.col("night_late") >= gain)
    learned = (F.col("rows") >= min_rows) & (F.col("held") >= min_held)
    return cells.withColumn("rule", F.when(learned & better, "night_wins").when(learned & (F.col("night_fit") - F.col("live_fit") >= gain), "keep_live").when(learned, "two_of_three").otherwise("inherit"))


def context_judge(live: str = "live_text", again: str = "context_text") -> Column:
    """Whether a second decoding may replace the first: it has words and differs."""
    from ..core import blank

    return ~blank(F.col(again)) & ~F.col(again).eqNullSafe(F.col(live))
