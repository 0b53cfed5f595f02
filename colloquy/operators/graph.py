"""The conversation graph: promises, notes, reminders, digests, sets of terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import timerefs

MAX_WHAT = 240


def time_references(turns: DataFrame, tz: str = "UTC") -> DataFrame:
    """(id, raw, resolved_ns, kind), a row a reference, resolved against the turn's own start."""
    return turns.select("id", F.explode(timerefs.time_refs(F.col("text"), F.col("t_start_ns"), tz)).alias("r")).select("id", "r.raw", "r.resolved_ns", "r.kind")


def commitments(turns: DataFrame, tz: str = "UTC") -> DataFrame:
    """Promise candidates of turns (id, thread_id, speaker_id, t_start_ns, text): a promiser, and somebody in the thread to be owed.

    segment_id, thread_id, who, to (if one other voice alone is there), what, due_ns, due_raw, due_kind, confidence.
    """
    voices = turns.where("speaker_id IS NOT NULL").select("thread_id", "speaker_id").distinct()
    others = voices.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.sum("speaker_id").alias("s"))
    rows = turns.where("speaker_id IS NOT NULL AND thread_id IS NOT NULL").where(T.promises(F.col("text"))).join(others, "thread_id").where("n > 1")
    refs = rows.withColumn("refs", timerefs.time_refs(F.col("text"), F.col("t_start_ns"), tz)).withColumn("due", timerefs.due_of(F.col("refs"), F.col("t_start_ns")))
    n = F.col("n") - 1
    what = F.trim("text")
    short = F.when(F.char_length(what) > MAX_WHAT, F.concat(F.rtrim(F.substring(what, 1, MAX_WHAT)), F.lit("…"))).otherwise(what)
    return refs.select(
        F.col("id").alias("segment_id"), "thread_id", F.col("speaker_id").alias("who"), F.when(n == 1, F.col("s") - F.col("speaker_id")).alias("to"), short.alias("what"),
        F.col("due.resolved_ns").alias("due_ns"), F.col("due.raw").alias("due_raw"), F.col("due.kind").alias("due_kind"), T.promise_confidence(F.col("due").isNotNull(), n).alias("confidence"),
    )


def notes(turns: DataFrame, tz: str = "UTC", wake: str = timerefs.WAKE) -> DataFrame:
    """(segment_id, text, due_ns) of notes to self that microphone turns open with a wake phrase."""
    @F.pandas_udf("long")
    def due(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([timerefs.reminder_due(t, int(a), tz) for t, a in zip(text, at, strict=True)], dtype="Int64")

    rows = turns.where("source_kind IN ('mic', 'room')").withColumn("note", timerefs.notes(F.col("text"), wake)).where("note IS NOT NULL")
    return rows.select(F.col("id").alias("segment_id"), F.col("note").alias("text"), due(F.col("note"), F.col("t_start_ns")).alias("due_ns"))


def due_reminders(notes: DataFrame, fired: DataFrame, now_ns: int) -> DataFrame:
    """Open notes that are due and have not fired: each fires once."""
    return notes.where(F.col("due_ns").isNotNull() & (F.col("due_ns") <= now_ns)).join(fired.select("segment_id"), "segment_id", "left_anti")


def digestible(threads: DataFrame, now_ns: int, min_turns: int = 8, settled_ns: int = 30 * 60 * 10**9) -> DataFrame:
    """Threads long enough, and settled long enough, to be summed up."""
    return threads.where((F.col("segments") >= min_turns) & (F.col("ended_ns") <= now_ns - settled_ns))


def name_labels(text: Column, names: Column) -> Column:
    """A summary with letters A, B, ... (in brackets) written as the names of an array."""
    return F.aggregate(F.transform(names, lambda n, i: F.struct(F.concat(F.lit("["), F.char(i + 65), F.lit("]")).alias("k"), n.alias("v"))), text, lambda acc, x: F.replace(acc, x["k"], x["v"]))


def bounded_union(*branches: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """Distinct rows of several sources, ``limit`` of them: each is bounded before they meet."""
    rows = None
    for b in branches:
        part = b.orderBy(*order).limit(limit)
        rows = part if rows is None else rows.unionByName(part)
    return rows.distinct().orderBy(*order).limit(limit)


def client_bridge(active: DataFrame, on: list[str], stream: str = "stream", instance: str = "instance", slack: int = 3, share: float = 0.85, clear: float = 0.10, least: int = 30) -> DataFrame:
    """(on, stream, instance, share): which instance a stream carries, over windows ``on``.

    ``active``: on, kind (stream or instance), name, bucket (100 ms). The share is
    the instance's buckets that lie within ``slack`` buckets of one of the stream's;
    the best must reach ``share``, be ``clear`` of the next, and have ``least`` buckets.
    """
    from pyspark.sql import Window as W

    s = active.where(F.col("kind") == "stream").select(*on, F.col("name").alias(stream), F.explode(F.sequence(F.col("bucket") - slack, F.col("bucket") + slack)).alias("bucket")).distinct()
    i = active.where(F.col("kind") == "instance").select(*on, F.col("name").alias(instance), "bucket").distinct()
    total = i.groupBy(*on, instance).agg(F.count(F.lit(1)).alias("n"))
    hits = i.join(s, [*on, "bucket"]).groupBy(*on, stream, instance).agg(F.count(F.lit(1)).alias("k")).join(total, [*on, instance])
    w = W.partitionBy(*on, stream).orderBy(F.col("share").desc(), instance)
    rows = hits.withColumn("share", F.col("k") / F.col("n")).withColumn("place", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("share").over(w), F.lit(0.0)))
    return rows.where((F.col("place") == 1) & (F.col("share") >= share) & (F.col("share") - F.col("next") >= clear - 1e-12) & (F.col("n") >= least)).select(*on, stream, instance, "share")


def overlap_stats(frames: DataFrame, keys: list[str], window: int = 50) -> DataFrame:
    """(keys, frac, max_frac) of frames (keys, at, voices): the share with two voices or more, overall and in the worst window of frames."""
    from pyspark.sql import Window as W

    two = (F.col("voices") >= 2).cast("double")
    w = W.partitionBy(*keys).orderBy("at").rowsBetween(-(window - 1), 0)
    rows = frames.withColumn("__w", F.avg(two).over(w)).withColumn("__k", F.count(F.lit(1)).over(w))
    return rows.groupBy(*keys).agg(F.avg(two).alias("frac"), F.max(F.when(F.col("__k") == window, F.col("__w"))).alias("w")).select(*keys, "frac", F.coalesce("w", "frac").alias("max_frac"))


def source_family(kind: Column) -> Column:
    """Sources that carry the same rooms: applications and users of one client; microphones; rooms."""
    return F.when(kind.isin("app", "discord user"), "app").when(kind == "mic", "mic").when(kind == "room", "room").otherwise("other")
