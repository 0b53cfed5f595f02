"""Structured Streaming: windows, stateful folds, an append log with replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..core import NS
from ..operators.sequences import VoiceRule


def event_counts(events: DataFrame, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts and sums of a stream (ts, event_type, value); rows later than ``late`` are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def inactivity_sessions(events: DataFrame, gap: str, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Sessions by inactivity of a stream (ts, key)."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_versions(rows: DataFrame, key: str = "id", version: str = "revision") -> DataFrame:
    """The newest version of each row of a stream: a correction after the fact is an update, whenever it comes. Output mode update."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def _timeout(wanted: bool) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if wanted else GroupStateTimeout.NoTimeout


_SPAN = "key string, start bigint, end bigint, voiced_start bigint, voiced_end bigint"


def merge_stream(spans: DataFrame, gap: int, longest: int, idle_ms: int | None = 60_000) -> DataFrame:
    """Turn merging over a stream of spans (key, start, end, voiced_start, voiced_end), a state of one open turn a key.

    An open turn is given out when a span that cannot join it comes, or when
    nothing has come for ``idle_ms`` (None: never, as a drained backlog wants it). Spans of one micro-batch are taken in order.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(("start", "end", "voiced_start", "voiced_end"), state.get, strict=True)) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([{"key": key[0], **held}])
            return
        rows = pd.concat(list(pdfs)).sort_values(["voiced_start", "voiced_end"])[["start", "end", "voiced_start", "voiced_end"]].to_dict("records")
        *closed, last = _merged([*([held] if held else []), *rows], gap, longest)
        state.update(tuple(int(last[k]) for k in ("start", "end", "voiced_start", "voiced_end")))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if closed:
            yield pd.DataFrame([{"key": key[0], **c} for c in closed])

    return spans.groupBy("key").applyInPandasWithState(run, _SPAN, "start long, end long, voiced_start long, voiced_end long", "append", _timeout(idle_ms is not None))


def _merged(rows: list[dict], gap: int, longest: int) -> list[dict]:
    from ..operators.sequences import merge_turns

    return list(merge_turns(rows, gap, longest))


def voice_stream(frames: DataFrame, idle_ms: int | None = 60_000, **limits) -> DataFrame:
    """Voice activity over a stream of frames (key, at, length, prob): the segmenter's state a key; a stream that falls silent is flushed."""
    rule = VoiceRule(**limits)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, last, heard = state.get if state.exists else (None, None, 0)
        open_ = None if begin is None else (begin, last)
        if state.hasTimedOut:
            state.remove()
            out = rule.close(open_, heard)
        else:
            out = []
            for r in pd.concat(list(pdfs)).sort_values("at").itertuples():
                open_, closed = rule.after(open_, int(r.at), int(r.length), r.prob)
                heard = int(r.at) + int(r.length)
                out += closed
            state.update((*(open_ or (None, None)), heard))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame([{"key": key[0], **s} for s in out])[["key", "start", "end", "voiced_start", "voiced_end"]]

    return frames.groupBy("key").applyInPandasWithState(run, _SPAN, "start long, voiced_end long, heard long", "append", _timeout(idle_ms is not None))


def span_stream(edges: DataFrame, open_ms: int = 30_000, timeout: bool = True) -> DataFrame:
    """Speaking spans of a stream of edges (key, at_ns, edge): a start without an end closes after ``open_ms`` of its own time."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_at = state.get[0] if state.exists else None
        out, cap = [], open_ms * 1_000_000
        if state.hasTimedOut:
            state.remove()
            out.append((open_at, open_at + cap, False))
        else:
            for r in pd.concat(list(pdfs)).sort_values("at_ns").itertuples():
                if open_at is not None:
                    end = min(int(r.at_ns), open_at + cap)
                    if end > open_at:
                        out.append((open_at, end, r.at_ns <= open_at + cap))
                open_at = int(r.at_ns) if r.edge == "start" else None
            if open_at is None:
                if state.exists:
                    state.remove()
            else:
                state.update((open_at,))
                if timeout:
                    state.setTimeoutDuration(open_ms)
        if out:
            yield pd.DataFrame(out, columns=["t_start_ns", "t_end_ns", "closed"]).assign(key=key[0])[["key", "t_start_ns", "t_end_ns", "closed"]]

    return edges.groupBy("key").applyInPandasWithState(run, "key string, t_start_ns long, t_end_ns long, closed boolean", "open_ns long", "append", _timeout(timeout))


def suppress_duplicates(mic: DataFrame, app: DataFrame, late: str = "1 minute", skew: str = "2 seconds") -> DataFrame:
    """(mic_id, app_id) pairs of two streams (id, ts, end_ts, print) whose audio prints match within the skew: observations, not second rows."""
    a = mic.withWatermark("ts", late).select(F.col("id").alias("mic_id"), F.col("ts").alias("m_ts"), F.col("print").alias("m_print"))
    b = app.withWatermark("ts", late).select(F.col("id").alias("app_id"), F.col("ts").alias("a_ts"), F.col("print").alias("a_print"))
    return a.join(b, F.expr(f"m_print = a_print AND m_ts BETWEEN a_ts - INTERVAL {skew} AND a_ts + INTERVAL {skew}"))


class EventLog:
    """A bus as an append log: numbered events, replay from a number, resync where the log no longer reaches.

    ``publish`` is for ``foreachBatch``: a batch that is written again after a
    failure keeps its numbers, as they derive from the batch's own, so nothing is
    given out twice. Ephemeral events take numbers but are not kept.
    """

    #: Numbers set aside for a batch.
    STRIDE = 1 << 32

    def __init__(self, path: str, keep: int = 10_000):
        self.path, self.keep = path, keep

    def publish(self, batch: DataFrame, batch_id: int) -> None:
        """Appends (topic, ev, data, ephemeral, at_ns) in the order of at_ns."""
        from ..operators.paging import numbered

        rows, n = numbered(batch.withColumn("__h", F.xxhash64("topic", "ev", "data")), ["at_ns", "__h"], 8)
        if n:
            kept = rows.where("NOT ephemeral").select((F.col("row_no") + 1 + batch_id * self.STRIDE).alias("seq"), "topic", "ev", "data", "at_ns")
            kept.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id:012d}")

    def events_since(self, spark, since: int, topics: list[str] | None = None) -> tuple[str, DataFrame | None]:
        """("events", rows after ``since`` in order), or ("resync", None) if it lies beyond the log's end or before what is kept."""
        rows = spark.read.parquet(self.path)
        newest = rows.select("seq").orderBy(F.col("seq").desc()).limit(self.keep).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        if newest.hi is None:
            return ("events", rows.limit(0)) if since == 0 else ("resync", None)
        dropped = newest.n == self.keep
        if since > newest.hi or (dropped and since + 1 < newest.lo):
            return "resync", None
        out = rows.where((F.col("seq") > since) & (F.col("seq") >= newest.lo))
        return "events", (out if topics is None else out.where(F.col("topic").isin(topics))).drop("batch").orderBy("seq")


def fire_reminders(fired_path: str):
    """A ``foreachBatch`` function that writes each due note (segment_id, due_ns, text) once to ``fired_path``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(fired_path)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            batch = batch.join(spark.read.parquet(fired_path).where(F.col("batch") != batch_id).select("segment_id"), "segment_id", "left_anti")
        batch.dropDuplicates(["segment_id"]).write.mode("overwrite").parquet(f"{fired_path}/batch={batch_id}")

    return run


def partial_captions(slices: DataFrame, finals: DataFrame) -> DataFrame:
    """What is shown now: the newest slice of each turn (turn_id, seq, text) that has no final text yet, and all final ones."""
    newest = slices.groupBy("turn_id").agg(F.max_by("text", "seq").alias("text"))
    open_ = newest.join(finals.select("turn_id"), "turn_id", "left_anti").withColumn("final", F.lit(False))
    return open_.unionByName(finals.select("turn_id", "text").withColumn("final", F.lit(True)))


def bounded_intake(rows: DataFrame, most: int, key: str = "source") -> DataFrame:
    """Back-pressure on a micro-batch (key, seq, kind): drops the oldest audio beyond ``most`` a key, never control events nor the last buffer.

    Adds ``dropped``, so that what is lost is counted, not silent.
    """
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(key, "kind").orderBy(F.col("seq").desc()))
    return rows.withColumn("dropped", (F.col("kind") == "audio") & (place > max(1, most)))


STOP_AFTER_NS = 30 * NS
