"""Shared pieces of the text operators: scratch tables, word hashing, Arrow maps.

Scratch tables live in the folder named by ``spark.checkpoint.dir`` (shared by
driver and executors); a local folder is used only where that setting is unset
*and* the master is local, as in tests.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
_local_scratch: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder."""
    global _local_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="colloquy-scratch-")
    return f"file://{_local_scratch}"


class Scratch:
    """Tables written once under the shared folder, so that lineage ends there.

    A lost executor costs at most the tasks of the stage that runs; what was
    written stays readable. ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, name: str = "t", compression: str = "zstd") -> DataFrame:
        """``df`` written and read again. zstd holds native memory for each file until the next collection: not for many small files."""
        self.n += 1
        path = f"{self.path}/{self.n:02d}-{name}"
        with _small_batches(self.spark):
            df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """A table that joins on ``key`` without being shuffled again. The catalog knows its name only until it is read here; the files stay."""
        self.n += 1
        name, path = f"scratch_{uuid.uuid4().hex}", f"{self.path}/{self.n:02d}-buckets"
        with _small_batches(self.spark):
            df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is computed once, however often ``body`` names it, in lambdas too."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def packed(docs: DataFrame, name: str = "row") -> DataFrame:
    """The caller's rows as one struct column, so that no name of theirs meets a name of ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name))


def unpacked(df: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None, name: str = "row") -> DataFrame:
    """The columns of ``docs`` again, those in ``changed`` with new values of the same types."""
    kinds = dict(docs.dtypes)
    return df.select(*((changed[c].cast(kinds[c]) if changed and c in changed else F.col(f"{name}.`{c}`")).alias(c) for c in docs.columns))


@contextlib.contextmanager
def _small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While a table is written, at most ``rows`` documents are in an Arrow batch: ten thousand long texts at a time are much memory for nothing."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) > 0:
        spark.conf.set(key, str(min(int(before), rows)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def binary_text(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the text as UTF-8 bytes (null: null) under the fixed name ``__text``."""
    return df.select(*keep, F.col(text_col).cast("binary").alias("__text"))


def map_batches(df: DataFrame, fn: Callable, schema: str, *args) -> DataFrame:
    """``mapInArrow`` with ``fn(batches, *args)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(fn(batches, *args))

    return df.mapInArrow(run, schema)


def trimmed(out: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``out`` gives; then the worker, which stays for other tasks, hands freed memory back."""
    try:
        yield from out
    finally:
        trim()


def trim() -> None:
    """Hands memory that this process has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunked(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "__text") -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``most_bytes`` at most (one long row may exceed it)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = np.frombuffer(_lengths(b.column(b.schema.get_field_index(column))), np.int64)
        cut = np.cumsum(size) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def _lengths(column: pa.Array) -> bytes:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes()


class WordHash(dict):
    """word bytes -> 64-bit hash, computed once a word; bounded, as it starts anew when full."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of a sequence of word hashes; of the whole sequence if it is shorter."""
    n = min(n, len(h))
    if n == 0:
        return h[:0]
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out *= _M1
        out += h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return mix64(out)


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    """``np.unique`` of numbers, by the faster of numpy's ways."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has each key once and in ``count`` how many of the ``total`` rows of ``left`` have it.

    Keys of more than a ``share``-th of all rows, of which there are less than
    ``share``, are broadcast, so their rows stay where they are; the rest is shuffled.
    """
    hot = right.where(F.col(count) > total / share)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(count) <= total / share), keys)
    return left.join(F.broadcast(hot), keys).unionByName(cold)


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have ``most_rows`` at most; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
