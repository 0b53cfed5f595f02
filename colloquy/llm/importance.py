"""Quality by importance resampling.

Two bags of hashed word n-grams (n = 1, 2) are estimated: of the target, the
documents labelled good, and of the raw corpus, all documents. A document's
importance is the log ratio of its probability under the two; adding Gumbel
noise, fixed by the hash of its id, and taking the largest values draws without
replacement in proportion to importance (Gumbel top-k).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, binary_text, chunked, map_batches, mix64, ngram_hashes, small, trimmed

#: Buckets of the models, the share of documents drawn, the count added to each bucket.
BUCKETS, KEEP, SMOOTH, SEED = 1 << 14, 0.5, 1.0, 11


def buckets(text: bytes, hashes: WordHash, n: int = BUCKETS) -> np.ndarray:
    h = hashes.of(text.lower().split())
    grams = np.concatenate([mix64(h), ngram_hashes(h, 2)]) if len(h) > 1 else mix64(h)
    return (grams % np.uint64(n)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Sums of a whole task: a row a bucket that occurs."""
    hashes, raw, target = WordHash(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for b in chunked(batches, 8 << 20):
        good = b.column(0).to_pylist()
        for g, t in zip(good, b.column(1), strict=True):
            c = np.bincount(buckets(t.as_py() or b"", hashes, n), minlength=n)
            raw += c
            if g:
                target += c
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def _weights(batches: Iterator[pa.RecordBatch], keep: int, ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for b in chunked(batches, 8 << 20):
        out = [float(ratio[buckets(t.as_py() or b"", hashes, len(ratio))].sum()) for t in b.column(keep)]
        yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(out, pa.float64())], [*b.schema.names[:keep], "log_weight"])


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, n: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams free log_weight, score, kept: a row for each row of ``docs``.

    The target is every document with a label ``quality`` of 1; without any, all
    weights are 0 and the draw is uniform. ``kept`` marks the round(keep * rows)
    rows with the largest scores; rows that tie with the last of them are kept
    too (rows with one id and text tie). Null texts have no n-grams and weight 0.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "importance")
    good = small(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(True)), 1_000_000)
    rows = binary_text(docs, [F.col("doc_id").cast("long").alias("doc_id")])
    counted = map_batches(rows.join(good, "doc_id", "left").select("good", "__text"), _counts, "bucket long, raw long, target long", n).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(n, SMOOTH), np.full(n, SMOOTH)
    for r in counted.collect():  # a row a bucket: n at most
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > SMOOTH * n else np.zeros(n)
    held = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(_weights(batches, 1, held.value))

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0))), 11) + 0.5) / F.lit(float(1 << 53))
    scored = rows.mapInArrow(run, "doc_id long, log_weight double").withColumn("score", F.col("log_weight") - F.log(-F.log(u)))
    scored = scratch.table(scored, "scored")
    least = kth_largest(scored, "score", round(keep * scored.count()))
    kept = F.col("score") >= F.lit(least) if least is not None else F.lit(False)
    return scored.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("score", 6).alias("score"), kept.alias("kept"))


def kth_largest(df: DataFrame, column: str, k: int, ways: int = 1024) -> float | None:
    """The k-th largest number of a column, exactly, by narrowing a range: each round counts ``ways`` parts of it."""
    if k <= 0:
        return None
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    above = 0
    while lo < hi:
        width = (hi - lo) / ways
        part = F.least(F.lit(ways - 1), F.floor((F.col(column) - lo) / width).cast("long")) if width > 0 else F.lit(0)
        inside = df.where(F.col(column).between(lo, hi)).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(inside, key=lambda r: -r.lo):
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
        if len(inside) == 1 and width <= 0:
            break
    return lo
