"""Readers: logs, line-delimited JSON, audio files; what is malformed goes to one side instead of failing a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import NS

RATE = 16_000
CORRUPT = "_corrupt_record"


def ndjson(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) lines of a folder of JSON lines: one bad line never takes others along."""
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("r", parsed)
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return rows.where(~bad).select("r.*").drop(CORRUPT), rows.where(bad).select(F.col("value").alias("line"))


def local_to_ns(stamp: Column, tz: str = "UTC", pattern: str = "yyyy.MM.dd HH:mm:ss") -> Column:
    """UTC nanoseconds of a local time without a zone; null if it is no time."""
    return F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(stamp, F.lit(pattern)), tz)) * 1000


def instance_log(lines: DataFrame, tz: str = "UTC") -> DataFrame:
    """(t_ns, event, who, world_id, instance, room) of log lines (value): join, leave, world, room; other lines go."""
    head = r"^(\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}:\d{2}) .*?\[Behaviour\] "
    v, tail = F.col("value"), r"\s*$"
    person = lambda verb: F.regexp_extract(v, head + rf"OnPlayer{verb} (.+?)(?: \(usr_[0-9a-fA-F-]+\))?" + tail, 2)
    world = lambda k: F.regexp_extract(v, head + r"Joining (wrld_[0-9a-fA-F-]+):(\S+)" + tail, k)
    room = F.trim(F.regexp_extract(v, head + r"Entering Room: (.+)" + tail, 2))
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    rows = lines.select(local_to_ns(F.substring(v, 1, 19), tz).alias("t_ns"), some(person("Joined")).alias("joined"), some(person("Left")).alias("left"), some(world(2)).alias("world_id"), F.split(world(3), "~")[0].alias("instance"), some(room).alias("room"))
    event = F.when(F.col("joined").isNotNull(), "join").when(F.col("left").isNotNull(), "leave").when(F.col("world_id").isNotNull(), "world").when(F.col("room").isNotNull(), "room")
    return rows.withColumn("event", event).where("event IS NOT NULL AND t_ns IS NOT NULL").select("t_ns", "event", F.coalesce("joined", "left").alias("who"), "world_id", some(F.col("instance")).alias("instance"), "room")


def visits(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, world_id, world_name, instance_id, t_start_ns, t_end_ns): each entry ends the one before; the same entry twice is one.

    A name belongs to its world: every visit of a world has the newest name it was given.
    """
    from pyspark.sql import Window as W

    from ..operators.joins import asof_join

    keys = keys or []
    entries = log.where("event = 'world'").select(*keys, "world_id", F.col("instance").alias("instance_id"), F.col("t_ns").alias("t_start_ns")).dropDuplicates([*keys, "world_id", "t_start_ns"])
    w = W.partitionBy(*keys).orderBy("t_start_ns")
    rows = entries.withColumn("t_end_ns", F.min("t_start_ns").over(w.rangeBetween(1, W.unboundedFollowing)))
    one = [] if keys else ["__one"]
    tag = lambda df: df if keys else df.withColumn("__one", F.lit(0))
    named = asof_join(tag(log.where("event = 'room'").select(*keys, "t_ns", "room")), tag(entries.select(*keys, "world_id", "t_start_ns")), keys or one, "t_ns", "t_start_ns").where("world_id IS NOT NULL")
    names = named.groupBy("world_id").agg(F.max_by("room", "t_ns").alias("world_name"))
    return rows.join(names, "world_id", "left").select(*keys, "world_id", "world_name", "instance_id", "t_start_ns", "t_end_ns")


def roster(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, name, joined_ns, left_ns): presence of people; a change of world ends everyone's; a second join while present is nothing."""
    from pyspark.sql import Window as W

    keys = keys or []
    changes = log.where("event = 'world'").select(*keys, F.col("t_ns").alias("w_ns"))
    people = log.where("event IN ('join', 'leave')").select(*keys, "who", "t_ns", "event")
    names = people.select(*keys, "who").distinct()
    tag = keys or ["__one"]
    if not keys:
        names, changes = names.withColumn("__one", F.lit(0)), changes.withColumn("__one", F.lit(0))
    # a change of world is a leave of everyone who was ever seen before it
    first = people.groupBy(*keys, "who").agg(F.min("t_ns").alias("first_ns"))
    ends = names.join(first, [*keys, "who"]).join(changes, tag).where("w_ns > first_ns").select(*keys, "who", F.col("w_ns").alias("t_ns"), F.lit("leave").alias("event"))
    w = W.partitionBy(*keys, "who").orderBy("t_ns", F.col("event").desc())
    rows = people.unionByName(ends).withColumn("prev", F.lag("event").over(w)).where("NOT event <=> prev")
    rows = rows.withColumn("next_ns", F.lead("t_ns").over(w))
    return rows.where("event = 'join'").select(*keys, F.col("who").alias("name"), F.col("t_ns").alias("joined_ns"), F.col("next_ns").alias("left_ns"))


def audio_frames(lines: DataFrame, now_ns: int, max_ms: int = 2_000, max_skew_s: int = 60) -> tuple[DataFrame, DataFrame]:
    """(frames, rejected with a reason) of per-user audio (user_id, rate, at_ns, pcm base64): rates 8 to 96 kHz, a minute's skew."""
    rows = lines.withColumn("data", F.try_to_binary("pcm", F.lit("base64"))).withColumn("ms", F.expr("octet_length(data) div 2 * 1000 div rate"))
    reason = (
        F.when(F.col("user_id").isNull() | (F.trim("user_id") == ""), "no_user")
        .when(F.col("rate").isNull() | ~F.col("rate").between(8_000, 96_000), "rate")
        .when(F.col("data").isNull() | (F.octet_length("data") % 2 != 0) | (F.octet_length("data") == 0), "audio")
        .when(F.abs(F.col("at_ns") - now_ns) > max_skew_s * NS, "clock")
        .when(F.col("ms") > max_ms, "too_long")
    )
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").select("user_id", "rate", "at_ns", "data", "ms"), rows.where("reason IS NOT NULL").select("user_id", "at_ns", "reason")


def sample_time(t0_ns: Column, samples: Column, rate: int = RATE) -> Column:
    """When a sample was: t0 + samples / rate, in whole nanoseconds without overflow."""
    return (t0_ns.cast("decimal(38,0)") + F.floor(samples.cast("decimal(38,0)") * NS / rate)).cast("long")


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, pcm): 16-bit samples of WAV files, little-endian, interleaved; files that are none have nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rate, channels, pcm = _wav(b.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.array([pcm], pa.binary())], ["path", "rate", "channels", "pcm"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, rate int, channels int, pcm binary")


def _wav(data: bytes) -> tuple:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None, None, None
    at, rate, channels = 12, None, None
    while at + 8 <= len(data):
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + n]
        if name == b"fmt " and len(body) >= 16:
            if int.from_bytes(body[:2], "little") != 1 or int.from_bytes(body[14:16], "little") != 16:
                return None, None, None
            channels, rate = int.from_bytes(body[2:4], "little"), int.from_bytes(body[4:8], "little")
        if name == b"data":
            return rate, channels, body
        at += 8 + n + (n & 1)
    return None, None, None


def downmix(pcm: np.ndarray, channels: int) -> np.ndarray:
    """The mean of the channels of interleaved samples; a last incomplete frame goes."""
    return pcm[: len(pcm) // channels * channels].reshape(-1, channels).mean(1)


class Resampler:
    """Linear resampling in pieces: what one piece leaves over starts the next, so pieces give what the whole gives."""

    def __init__(self, rate_in: int, rate_out: int = RATE):
        self.step, self.at, self.last = rate_in / rate_out, 0.0, None

    def push(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        line = x if self.last is None else np.concatenate([[self.last], x])
        base = 0.0 if self.last is None else -1.0
        n = max(0, int(np.floor((len(line) - 1 + base - self.at) / self.step)) + 1) if len(line) - 1 + base >= self.at else 0
        points = self.at + self.step * np.arange(n)
        out = np.interp(points - base, np.arange(len(line)), line)
        self.at = self.at + self.step * n - len(x)
        self.last = line[-1]
        return out


def duplicate_audio(a: np.ndarray, b: np.ndarray, rate: int = RATE, anchors: int = 3, skew_s: float = 2.0, least: float = 0.8) -> tuple[bool, float]:
    """(same, correlation): whether two recordings carry the same sound, apart from gain and up to two seconds of skew.

    Several anchor pieces of the shorter one are looked for in the other; all must be found at one shift.
    """
    if len(a) > len(b):
        a, b = b, a
    piece, reach = len(a) // (anchors + 1), int(skew_s * rate)
    if piece < rate // 10 or max(len(a), len(b)) > 15 * rate:
        return False, 0.0
    found = []
    for k in range(anchors):
        lo = (2 * k + 1) * len(a) // (2 * anchors) - piece // 2
        x = a[lo : lo + piece] - a[lo : lo + piece].mean()
        start = max(0, lo - reach)
        y = b[start : min(len(b), lo + piece + reach)]
        if len(y) < piece or not x.any():
            return False, 0.0
        dots = np.fft.irfft(np.fft.rfft(y, 2 * len(y)) * np.conj(np.fft.rfft(x, 2 * len(y))))[: len(y) - piece + 1]
        s1, s2 = np.cumsum(np.insert(y, 0, 0.0)), np.cumsum(np.insert(y * y, 0, 0.0))
        energy = np.maximum(s2[piece:] - s2[:-piece] - (s1[piece:] - s1[:-piece]) ** 2 / piece, 1e-12)
        score = dots / np.sqrt(energy * (x @ x))
        at = int(np.abs(score).argmax())
        found.append((start + at - lo, float(abs(score[at]))))
    shifts, scores = zip(*found, strict=True)
    same = min(scores) >= least and max(shifts) - min(shifts) <= rate // 100
    return same, min(scores)
