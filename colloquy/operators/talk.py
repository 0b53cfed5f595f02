"""Turn-taking: shares, monologues, interruptions, response times.

Turns are read in (thread, start, id) order. A turn without a voice counts for
nobody and breaks nobody's run. All statistics of all voices come from two
passes: one window a thread, one aggregation a voice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import NS, exact_median, need

#: Overlap from which a turn's start interrupts; the longest gap that still is a response; conversations listed a voice.
INTERRUPTION_OVERLAP, LATENCY_CAP_MS, BY_CONVERSATION = 0.1, 5_000, 10


def speech() -> Column:
    return F.greatest(F.lit(0), F.col("t_end_ns") - F.col("t_start_ns"))


def shares(turns: DataFrame) -> DataFrame:
    """thread_id, speaker_id, turns, speech_ns, share: identified speech in both parts of the fraction."""
    per = turns.where("speaker_id IS NOT NULL").groupBy("thread_id", "speaker_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(speech()).alias("speech_ns"))
    total = F.sum("speech_ns").over(W.partitionBy("thread_id"))
    return per.withColumn("share", F.when(total > 0, F.col("speech_ns") / total).otherwise(0.0))


def interruptions(turns: DataFrame, bucket_ns: int = 30 * NS, threshold: float = INTERRUPTION_OVERLAP) -> DataFrame:
    """(thread_id, by_id, of_id): b began, overlapped, while another voice's turn a that had begun before was still running.

    The pairs meet through time buckets within a thread, so a thread's length
    does not matter, only how many turns run at one time.
    """
    rows = turns.where("speaker_id IS NOT NULL")
    b = rows.where(F.coalesce("overlap_frac", F.lit(0.0)) >= threshold).select("thread_id", F.col("speaker_id").alias("by_id"), F.col("t_start_ns").alias("at"), F.floor(F.col("t_start_ns") / bucket_ns).alias("k"))
    a = rows.where("t_end_ns > t_start_ns").select("thread_id", F.col("speaker_id").alias("of_id"), "t_start_ns", "t_end_ns", F.explode(F.sequence(F.floor(F.col("t_start_ns") / bucket_ns), F.floor((F.col("t_end_ns") - 1) / bucket_ns))).alias("k"))
    return b.join(a, ["thread_id", "k"]).where("by_id <> of_id AND t_start_ns < at AND at < t_end_ns").select("thread_id", "by_id", "of_id")


def _ordered(turns: DataFrame) -> DataFrame:
    """Identified turns with the voice and end of the identified turn before."""
    w = W.partitionBy("thread_id").orderBy("t_start_ns", "id")
    return turns.where("speaker_id IS NOT NULL").withColumn("prev_speaker", F.lag("speaker_id").over(w)).withColumn("prev_end_ns", F.lag("t_end_ns").over(w))


def monologues(turns: DataFrame) -> DataFrame:
    """(thread_id, speaker_id, run, run_ns): runs of one voice, from the first start to the latest end."""
    w = W.partitionBy("thread_id").orderBy("t_start_ns", "id")
    rows = _ordered(turns).withColumn("run", F.sum(F.when(F.col("prev_speaker").eqNullSafe(F.col("speaker_id")), 0).otherwise(1)).over(w))
    return rows.groupBy("thread_id", "speaker_id", "run").agg(F.greatest(F.lit(0), F.max("t_end_ns") - F.min("t_start_ns")).alias("run_ns"))


def latencies(turns: DataFrame, cap_ms: int = LATENCY_CAP_MS) -> DataFrame:
    """(thread_id, speaker_id, gap_ms): whole milliseconds from the end of the identified turn before, if another voice's, within the cap."""
    gap = F.expr("(t_start_ns - prev_end_ns) div 1000000")
    return _ordered(turns).where("prev_speaker <> speaker_id").select("thread_id", "speaker_id", gap.alias("gap_ms")).where((F.col("gap_ms") >= 0) & (F.col("gap_ms") <= cap_ms))


def person_stats(turns: DataFrame, bucket_ns: int = 30 * NS) -> DataFrame:
    """A row a voice, over every thread it takes part in.

    turns, speech_ns, total_speech_ns (of all identified voices there), share,
    mean_turn_ns (whole), longest_monologue_ns, interruptions_given and
    _received, median_latency_ms (null if it never answered), span_ns,
    turns_per_minute (of the threads' clock).
    """
    per = turns.where("speaker_id IS NOT NULL").groupBy("thread_id", "speaker_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(speech()).alias("speech_ns"))
    threads = turns.groupBy("thread_id").agg(F.greatest(F.lit(0), F.max("t_end_ns") - F.min("t_start_ns")).alias("span_ns"), F.coalesce(F.sum(F.when(F.col("speaker_id").isNotNull(), speech())), F.lit(0)).alias("total_speech_ns"))
    base = per.join(threads, "thread_id").groupBy("speaker_id").agg(F.sum("turns").alias("turns"), F.sum("speech_ns").alias("speech_ns"), F.sum("total_speech_ns").alias("total_speech_ns"), F.sum("span_ns").alias("span_ns"))
    runs = monologues(turns).groupBy("speaker_id").agg(F.max("run_ns").alias("longest_monologue_ns"))
    pairs = interruptions(turns, bucket_ns)
    given = pairs.groupBy(F.col("by_id").alias("speaker_id")).agg(F.count(F.lit(1)).alias("interruptions_given"))
    received = pairs.groupBy(F.col("of_id").alias("speaker_id")).agg(F.count(F.lit(1)).alias("interruptions_received"))
    median = latencies(turns).groupBy("speaker_id").agg(exact_median("gap_ms").alias("median_latency_ms"))
    out = base
    for part in (runs, given, received, median):
        out = out.join(part, "speaker_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "speaker_id", "turns", "speech_ns", "total_speech_ns",
        F.when(F.col("total_speech_ns") > 0, F.col("speech_ns") / F.col("total_speech_ns")).otherwise(0.0).alias("share"),
        F.expr("speech_ns div turns").alias("mean_turn_ns"),
        zero("longest_monologue_ns"), zero("interruptions_given"), zero("interruptions_received"), "median_latency_ms", "span_ns",
        F.when(F.col("span_ns") > 0, F.col("turns") / (F.col("span_ns") / 6e10)).otherwise(0.0).alias("turns_per_minute"),
    )


def by_conversation(turns: DataFrame, limit: int = BY_CONVERSATION) -> DataFrame:
    """speaker_id, thread_id, turns, share, last_ns: each voice's newest conversations."""
    last = turns.groupBy("thread_id").agg(F.max("t_end_ns").alias("last_ns"))
    rows = shares(turns).join(last, "thread_id")
    place = F.row_number().over(W.partitionBy("speaker_id").orderBy(F.col("last_ns").desc(), F.col("thread_id").desc()))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("speaker_id", "thread_id", "turns", "share", "last_ns", "place")


def since(turns: DataFrame, now_ns: int, days: int, speaker_id: int) -> DataFrame:
    """The turns of the last ``days``, in the threads that the voice takes part in within them; a thread that is cut counts as what is left of it."""
    need(days > 0, "days must be positive")
    recent = turns.where(F.col("t_start_ns") >= now_ns - days * 86_400 * NS)
    return recent.join(recent.where(F.col("speaker_id") == speaker_id).select("thread_id").distinct(), "thread_id", "left_semi")
