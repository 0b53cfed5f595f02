"""Rules that fold over time: voice activity, turn merging, threads, flaps, cuts.

Each rule is a plain Python fold over one group in time order (tested as such);
``folded`` runs it over all groups of a task, one after the other, on executors. The keys must bound a group: a
session's turns, a stream's frames of a day.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string as parsed

from ..core import NS

#: Rows a batch of results.
_OUT_ROWS = 10_000


def _plain(column: pa.Array) -> list:
    """Values of a column; what is not a number is null."""
    return column.to_pylist() if not pa.types.is_floating(column.type) else pc.if_else(pc.is_nan(column), None, column).to_pylist()


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """``fn`` over the rows of each key in order; it gives rows of ``schema`` (without the keys).

    Rows are dealt by key and sorted; a task walks through all its keys in one
    stream, so many small groups cost rows, not calls, and one group is held at a time.
    """
    kinds = dict(df.dtypes)
    names = [*keys, *(part.split()[0] for part in schema.split(", "))]
    whole = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *(F.col(c).asc_nulls_last() for c in order))
    out_schema = to_arrow_schema(parsed(whole))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
        key, held = None, []
        for b in batches:
            columns = [_plain(c) for c in b.columns]
            of = list(zip(*(columns[b.schema.names.index(k)] for k in keys), strict=True))
            for k, values in zip(of, zip(*columns, strict=True), strict=True):
                if held and k != key:
                    yield key, held
                    held = []
                key = k
                held.append(dict(zip(b.schema.names, values, strict=True)))
        if held:
            yield key, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, held in groups(batches):
            for r in fn(held):
                out.append((*key, *map(r.get, names[len(key) :])))
                if len(out) >= _OUT_ROWS:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), out_schema, strict=True)], names=names)

    return rows.mapInArrow(run, whole)


# ---- voice activity ----------------------------------------------------------


#: What is open: where speech began, and where it was last heard.
Open = tuple[int, int]


@dataclass(frozen=True)
class VoiceRule:
    """When frames of speech probability are a span; in samples (16 kHz by default).

    Speech opens with a voiced frame and closes where it was last heard, once
    ``min_silence`` has passed without; speech of ``longest`` is cut and goes on.
    Spans shorter than ``min_speech`` are none; ``pad`` is kept around the others.
    """

    threshold: float = 0.5
    min_speech: int = 4_000
    min_silence: int = 8_000
    pad: int = 3_200
    longest: int = 480_000

    def span(self, begin: int, end: int, heard: int) -> list[dict]:
        """The span of what has closed, if it is long enough; ``heard`` is as far as there is sound to keep."""
        if end - begin < self.min_speech:
            return []
        return [{"start": max(0, begin - self.pad), "end": min(heard, end + self.pad), "voiced_start": begin, "voiced_end": end}]

    def after(self, open_: Open | None, at: int, length: int, prob: float) -> tuple[Open | None, list[dict]]:
        """(what is open after a frame, what it closed)."""
        heard, voiced = at + length, prob >= self.threshold
        begin, last = (at if voiced else None, heard) if open_ is None else (open_[0], heard if voiced else open_[1])
        if begin is None:
            return None, []
        if open_ is not None and heard - begin >= self.longest:
            return (heard, heard) if voiced else None, self.span(begin, heard, heard)
        if heard - last >= self.min_silence:
            return None, self.span(begin, last, heard)
        return (begin, last), []

    def close(self, open_: Open | None, heard: int) -> list[dict]:
        """What the end of the frames closes."""
        return [] if open_ is None else self.span(*open_, heard)

    def spans(self, frames: Iterable[tuple[int, int, float]]) -> Iterator[dict]:
        """Spans of (at, length, prob) in order."""
        open_, heard = None, 0
        for at, length, prob in frames:
            open_, closed = self.after(open_, at, length, prob)
            heard = at + length
            yield from closed
        yield from self.close(open_, heard)


SPAN = "start bigint, end bigint, voiced_start bigint, voiced_end bigint"


def voice_spans(frames: DataFrame, keys: Sequence[str], **limits) -> DataFrame:
    """Spans of speech of frames (keys, at, length, prob): a silence closes at the last voiced end; what is too long is cut and goes on."""
    rule = VoiceRule(**limits)
    return folded(frames, keys, ["at"], lambda rows: rule.spans((r["at"], r["length"], r["prob"]) for r in rows), SPAN)


# ---- turn merging ------------------------------------------------------------


def merge_turns(rows: Iterable[dict], gap: int, longest: int) -> Iterator[dict]:
    """Joins spans over a silence of at most ``gap``, as long as the joined voiced length stays within ``longest``."""
    open_: dict | None = None
    for r in rows:
        r = {k: r[k] for k in ("start", "end", "voiced_start", "voiced_end")}
        if open_ is not None and max(0, r["voiced_start"] - open_["voiced_end"]) <= gap and max(0, r["voiced_end"] - open_["voiced_start"]) <= longest:
            open_ |= {"end": r["end"], "voiced_end": r["voiced_end"]}
        else:
            if open_ is not None:
                yield open_
            open_ = r
    if open_ is not None:
        yield open_


def merged_turns(spans: DataFrame, keys: Sequence[str], gap: int = 24_000, longest: int = 480_000) -> DataFrame:
    return folded(spans, keys, ["voiced_start", "voiced_end"], lambda rows: merge_turns(rows, gap, longest), SPAN)


# ---- threads -----------------------------------------------------------------

#: Voices that a thread knows: those that spoke last.
RECENT = 4


class _Thread:
    """A thread so far: when it ended, its latest voices, and how many of its turns have a voice, of how many voices."""

    def __init__(self, number: int, end: int):
        self.number, self.end, self.labelled = number, end, 0
        self.latest: deque = deque(maxlen=RECENT)
        self.everyone: set = set()

    @property
    def settled(self) -> bool:
        """Somebody has spoken twice."""
        return self.labelled > len(self.everyone)

    def add(self, voice, end: int) -> None:
        self.end = max(self.end, end)
        if voice is None:
            return
        self.labelled += 1
        self.everyone.add(voice)
        if voice in self.latest:
            self.latest.remove(voice)
        self.latest.append(voice)


def place_turns(rows: Iterable[dict], gap_ns: int) -> Iterator[dict]:
    """Adds ``thread`` (1, 2, ... in the group): an open thread that knows the voice, else the nearest if it has not settled, else a new one.

    Open: its last turn ended at most ``gap_ns`` before. A turn without a voice
    joins the nearest, the one that ended last (of two, the younger). A thread has
    settled once it has more labelled turns than voices; it knows its last four.
    """
    open_, made = [], 0
    for row in rows:
        begin, voice = row["t_start_ns"], row["speaker_id"]
        # the nearest first
        open_ = sorted((t for t in open_ if begin - t.end <= gap_ns), key=lambda t: (t.end, t.number), reverse=True)
        nearest = open_[:1]
        home = nearest if voice is None else [t for t in open_ if voice in t.latest] or [t for t in nearest if not t.settled]
        if not home:
            made += 1
            home = [_Thread(made, begin)]
            open_ += home
        home[0].add(voice, row["t_end_ns"])
        yield {"id": row["id"], "thread": home[0].number}


def thread_turns(turns: DataFrame, keys: Sequence[str], gap_s: float = 20.0) -> DataFrame:
    """(keys, id, thread) of turns. Sessions that a microphone bridges must share a key, so that they meet in one group."""
    return folded(turns.select(*keys, "id", "t_start_ns", "t_end_ns", "speaker_id"), keys, ["t_start_ns", "id"], lambda rows: place_turns(rows, int(gap_s * NS)), "id bigint, thread int")


def gap_sessions(df: DataFrame, keys: Sequence[str], time: str, gap: int, end: str | None = None, name: str = "session") -> DataFrame:
    """Numbers sessions by inactivity alone: a row begins one if it starts more than ``gap`` after all before it had ended."""
    w = W.partitionBy(*keys).orderBy(time)
    last = F.max(end or time).over(w.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(last.isNull() | (F.col(time) - last > gap), 1).otherwise(0)
    return df.withColumn("__new", begins).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


# ---- flaps -------------------------------------------------------------------


def flap_sessions(rows: Iterable[dict], grace_ms: int) -> Iterator[dict]:
    """Events appear / vanish of one source -> its sessions: one that comes back within the grace, as the same instance, goes on.

    Instances match unless both are known and differ. Rows: at_ms, event, instance.
    """
    start = end = None
    instance, flaps = None, 0
    for r in rows:
        if r["event"] == "vanish":
            if start is not None and end is None:
                end, instance = r["at_ms"], r["instance"] if r["instance"] is not None else instance
            continue
        if start is not None and end is not None:
            same = instance is None or r["instance"] is None or instance == r["instance"]
            if same and r["at_ms"] - end <= grace_ms:
                end, flaps = None, flaps + 1
                instance = r["instance"] if r["instance"] is not None else instance
                continue
            yield {"start_ms": start, "end_ms": end, "flaps": flaps}
            start, end, flaps, instance = r["at_ms"], None, 0, r["instance"]
        elif start is None:
            start, instance = r["at_ms"], r["instance"]
    if start is not None:
        yield {"start_ms": start, "end_ms": end, "flaps": flaps}


def flap_tolerant_sessions(events: DataFrame, keys: Sequence[str], grace_ms: int = 5_000) -> DataFrame:
    return folded(events, keys, ["at_ms"], lambda rows: flap_sessions(rows, grace_ms), "start_ms bigint, end_ms bigint, flaps int")


# ---- cuts inside a turn ------------------------------------------------------


def spaced_cuts(rows: Iterable[dict], spacing: float, most: int = 3, least: float = 0.8) -> Iterator[dict]:
    """The strongest cuts (at, distance) that keep ``spacing`` from each other, ``most`` of them, in order of place."""
    chosen: list[dict] = []
    for r in sorted(rows, key=lambda r: (-r["distance"], r["at"])):
        if len(chosen) < most and r["distance"] >= least and all(abs(r["at"] - c["at"]) >= spacing for c in chosen):
            chosen.append(r)
    for k, r in enumerate(sorted(chosen, key=lambda r: r["at"])):
        yield {"cut": k + 1, "at": r["at"], "distance": r["distance"]}


def turn_cuts(candidates: DataFrame, keys: Sequence[str], spacing: float = 1.0, most: int = 3, least: float = 0.8) -> DataFrame:
    return folded(candidates, keys, ["at"], lambda rows: spaced_cuts(rows, spacing, most, least), "cut int, at double, distance double")


def change_points(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, at, distance): how far the voices of neighbouring windows (keys, at, vector) are apart: 1 - cosine."""
    from ..functions.vectors import cosine

    w = W.partitionBy(*keys).orderBy("at")
    rows = windows.withColumn("before", F.lag("vector").over(w)).where("before IS NOT NULL")
    return rows.select(*keys, F.col("at").cast("double").alias("at"), (1 - cosine(F.col("before"), F.col("vector"))).alias("distance"))


# ---- speaking edges ----------------------------------------------------------


def speaking_spans(edges: DataFrame, keys: Sequence[str], open_ns: int = 30 * NS) -> DataFrame:
    """(keys, t_start_ns, t_end_ns, closed) of edges (keys, at_ns, edge): a second start closes the first at its own time.

    A start that nothing follows within ``open_ns`` closes there. A stop without a start is nothing.
    """
    w = W.partitionBy(*keys).orderBy("at_ns", F.col("edge").desc())
    rows = edges.withColumn("__next", F.lead("at_ns").over(w)).where("edge = 'start'")
    cap = F.col("at_ns") + open_ns
    end = F.least(F.coalesce("__next", cap), cap)
    return rows.select(*keys, F.col("at_ns").alias("t_start_ns"), end.alias("t_end_ns"), (F.coalesce("__next", cap + 1) <= cap).alias("closed")).where("t_end_ns > t_start_ns")


# ---- language of a conversation ----------------------------------------------


def language_context(turns: DataFrame, window: int = 10, min_clear: int = 3, min_agree: float = 0.7) -> DataFrame:
    """(id, context): the language of the last ``window`` stamped turns before each in its thread; null without a clear majority; a tie is German.

    Stamps are numbered first, so that the frame counts stamped turns, however many others lie between.
    """
    stamped = F.col("lang").isin("de", "en")
    w = W.partitionBy("thread_id").orderBy("t_start_ns", "id")
    # rows are keyed by how many stamps came before: a range frame over that number holds exactly the last ``window`` stamps
    before = F.coalesce(F.sum(F.when(stamped, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = turns.select("id", "thread_id", "t_start_ns", "lang").withColumn("__n", before)
    cumulated = {lang: F.coalesce(F.sum(F.when(F.col("lang") == lang, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for lang in ("de", "en")}
    rows = rows.withColumns({f"__{lang}": c for lang, c in cumulated.items()})
    marks = rows.where(stamped).select("thread_id", F.col("__n").alias("__at"), F.col("__de").alias("__de0"), F.col("__en").alias("__en0"))
    at = F.col("__n") - window
    out = rows.withColumn("__at", F.greatest(at, F.lit(0))).join(marks, ["thread_id", "__at"], "left")
    de, en = F.col("__de") - F.coalesce("__de0", F.lit(0)), F.col("__en") - F.coalesce("__en0", F.lit(0))
    best = F.greatest(de, en)
    ok = (de + en >= min_clear) & (best / (de + en) >= min_agree)
    return out.select("id", F.when(ok, F.when(de >= en, "de").otherwise("en")).alias("context"))
