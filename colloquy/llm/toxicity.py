"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i: the
document has a term (a word or the beginning of one) hashed to bucket i. The pair term, over low-rank vectors,
learns interactions such as an insult with the mention of a group, which an
additive linear model of terms misses. The model is fitted with numpy in one
task, so that only the fitted model comes to the driver, from a bounded sample
of labelled documents (``SAMPLE``, documented here); scoring reads every whole
document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, binary_text, chunked, map_batches, packed, trimmed, unpacked

#: Labelled documents to fit on at most: those with the smallest hashes of their ids; the distinct buckets of all of them together at most (64 MB in the task that fits).
SAMPLE, SAMPLE_BUCKETS = 12_000, 16_000_000
#: Hash buckets, rank, epochs. The buckets that take part tell labels apart alone or in a pair; documents that a bucket or a pair must have.
BITS, RANK, EPOCHS, SEED, SUPPORT = 20, 4, 30, 7, 5
FOLDS = 5
#: Buckets whose documents are held as bits at a time while pairs are screened (24 MB at ``SAMPLE`` documents).
BLOCK = 1 << 14
_TERM = regex.compile(rb"[a-z0-9\x80-\xff]+")


def features(word: bytes) -> tuple[bytes, ...]:
    """What a word is known by: itself and its first four and six bytes, so that inflected forms of one stem count together."""
    return word, b"^" + word[:4], b"^" + word[:6]


class _Buckets(dict):
    """word -> buckets of its features; bounded."""

    LIMIT = 1 << 17

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = tuple(xxhash.xxh3_64_intdigest(f) & self.mask for f in features(word))
        return found

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        return np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, words)), np.uint32))


def terms(text: bytes) -> set[bytes]:
    """Distinct terms: runs of ASCII letters (lower-cased), digits and non-ASCII letters' bytes."""
    return set(_TERM.findall(text.lower()))


def _bucket_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    of = _Buckets(bits)
    for b in chunked(batches, 8 << 20):
        sets = [of.of(terms(t.as_py() or b"")).tobytes() for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], ["id", "toxic", "buckets"])


@dataclass
class Model:
    bits: int
    active: np.ndarray  # sorted bucket numbers
    w0: float
    w: np.ndarray
    v: np.ndarray

    def parts(self) -> tuple:
        return self.bits, self.active, self.w0, self.w, self.v

    def places(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.active):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.active, buckets), len(self.active) - 1)
        return at[self.active[at] == buckets]

    def score(self, places: np.ndarray) -> float:
        z = self.w0
        if len(places):
            v = self.v[places]
            s = v.sum(0)
            z += self.w[places].sum() + 0.5 * float((s * s - (v * v).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def paired(sets: list[np.ndarray], y: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Buckets of pairs that tell what neither bucket tells alone, whatever their own share of toxic documents.

    A pair of ``SUPPORT`` toxic documents or more tells if so many toxic ones among
    those that have both would come by chance, at the greater of the two buckets' shares, less than once in
    a hundred such screenings of all pairs (Chernoff's bound on the binomial tail).
    """
    use = np.flatnonzero((a >= SUPPORT) & (c >= SUPPORT))
    m = len(use)
    if m < 2:
        return use[:0]
    beyond = np.log(m * (m - 1) / 2 / 0.01)
    # with k toxic documents the bound is greatest if none is clean, k * -log(q): buckets, then pairs, that cannot reach it go unopened
    use = use[a[use] * -np.log(a[use] / c[use]) > beyond - 1e-6]
    share, m, told = a[use] / c[use], len(use), np.zeros(len(use), bool)
    if m < 2:
        return use[:0]
    place = np.full(len(c), -1, np.int32)
    place[use] = np.arange(m, dtype=np.int32)
    first = np.argsort(-y, kind="stable")  # toxic documents first
    docs = [p[p >= 0] for p in (place[sets[d]] for d in first)]
    flat = np.concatenate(docs)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])[order]
    edges = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=m))))
    del place, docs, flat, order
    toxics = int((y > 0).sum())
    words, heads = -(-len(y) // 64), -(-toxics // 64)
    last = np.uint64((1 << (toxics % 64 or 64)) - 1)  # of the last word with toxic documents, their bits

    def bits(lo: int, hi: int) -> np.ndarray:
        """A bit a document for each bucket from ``lo`` to ``hi``."""
        out = np.empty((hi - lo, words), np.uint64)
        for b in range(lo, hi, 1024):
            e = min(hi, b + 1024)
            mark = np.zeros((e - b, words * 64), bool)
            mark[np.repeat(np.arange(e - b), np.diff(edges[b : e + 1])), owner[edges[b] : edges[e]]] = True
            out[b - lo : e - lo] = np.packbits(mark, axis=1, bitorder="little").view(np.uint64)
        return out

    def toxic_bits(rows: np.ndarray) -> np.ndarray:
        found = rows[:, :heads].T.copy()
        found[-1] &= last
        return found

    for lo in range(0, m, BLOCK):  # one block of columns in memory, whatever the number of buckets
        hi = min(m, lo + BLOCK)
        block = bits(lo, hi)
        toxic = toxic_bits(block)
        for i in range(hi - 1):
            row = block[i - lo : i - lo + 1] if i >= lo else bits(i, i + 1)
            start = max(i + 1, lo)
            k = np.bitwise_count(toxic[:, start - lo :] & toxic_bits(row)).sum(0, dtype=np.int32)
            q = np.maximum(share[i], share[start:hi])
            j = np.flatnonzero((k >= SUPPORT) & (k * -np.log(q) > beyond - 1e-6))
            if not len(j):
                continue
            k, q = k[j], q[j]
            j += start
            n = np.empty(len(j), np.int32)
            for b in range(0, len(j), 4096):
                n[b : b + 4096] = np.bitwise_count(block[j[b : b + 4096] - lo] & row).sum(1, dtype=np.int32)
            f = k / n
            more = f > q
            j, k, n, q, f = j[more], k[more], n[more], q[more], f[more]
            clean = np.where(k < n, (n - k) * np.log(np.maximum(1 - f, 1e-12) / (1 - q)), 0)
            hit = j[k * np.log(f / q) + clean > beyond]
            if len(hit):
                told[i] = True
                told[hit] = True
    return use[told]


def train(rows: list[tuple[int, bytes]], bits: int = BITS, rank: int = RANK, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fits the machine; deterministic. No rows or one class only: a model that gives the base rate."""
    y = np.array([t for t, _ in rows], np.float64)
    sets = [np.frombuffer(b, np.uint32) for _, b in rows]
    n, pos = len(rows), y.sum()
    base = float(np.log((pos + 0.5) / (n - pos + 0.5))) if n else -30.0
    none = Model(bits, np.zeros(0, np.uint32), base, np.zeros(0), np.zeros((0, rank)))
    if not n or pos in (0, n):
        return none
    a, c = np.zeros(1 << bits), np.zeros(1 << bits)  # toxic documents with the bucket, and all
    for t, s in zip(y, sets, strict=True):
        c[s] += 1  # a set has a bucket once
        a[s] += t
    expect = c * (pos / n)
    chi = np.where(c >= SUPPORT, (a - expect) ** 2 / np.maximum(expect * (1 - pos / n), 1e-9), 0)
    best = np.union1d(np.flatnonzero(chi > 6.6), paired(sets, y, a, c)).astype(np.uint32)  # 6.6: one in a hundred by chance
    if not len(best):
        return none
    model = Model(bits, best, base, np.zeros(len(best)), np.random.default_rng(seed).normal(0, 0.01, (len(best), rank)))
    places = [model.places(s) for s in sets]
    _fit(model, places, y, epochs, seed)
    return model


def _fit(model: Model, places: list[np.ndarray], y: np.ndarray, epochs: int, seed: int, batch: int = 256, rate: float = 0.1, l2: float = 1e-3) -> None:
    """AdaGrad over shuffled mini-batches; L2 on weights and vectors."""
    rng, (m, k) = np.random.default_rng(seed + 1), model.v.shape
    g0, gw, gv = 1e-6, np.full(m, 1e-6), np.full((m, k), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            ids = order[lo : lo + batch]
            rows = [places[i] for i in ids]
            n = np.array([len(r) for r in rows])
            idx = np.concatenate(rows) if n.sum() else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(ids)), n)
            vi = model.v[idx]
            s = np.stack([np.bincount(doc, weights=vi[:, r], minlength=len(ids)) for r in range(k)], 1)
            q = np.bincount(doc, weights=(vi * vi).sum(1), minlength=len(ids))
            z = model.w0 + np.bincount(doc, weights=model.w[idx], minlength=len(ids)) + 0.5 * ((s * s).sum(1) - q)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[ids]) / len(ids)
            d0 = e.sum()
            dw = np.bincount(idx, weights=e[doc], minlength=m) + l2 / len(y) * model.w
            pull = e[doc, None] * (s[doc] - vi)
            dv = np.stack([np.bincount(idx, weights=pull[:, r], minlength=m) for r in range(k)], 1) + l2 / len(y) * model.v
            g0 += d0 * d0
            gw += dw * dw
            gv += dv * dv
            model.w0 -= rate * d0 / np.sqrt(g0)
            model.w -= rate * dw / np.sqrt(gw)
            model.v -= rate * dv / np.sqrt(gv)


def _fitted(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    """The parts of the model of all rows (toxic, buckets) of the task, as one row."""
    rows: list[tuple[int, bytes]] = []
    for b in batches:
        rows.extend(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    m = train(sorted(rows), **options)
    parts = [m.bits], [m.active.tobytes()], [m.w0], [m.w.tobytes()], [m.v.tobytes()], [m.v.shape[1]]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int32(), pa.binary(), pa.float64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["bits", "active", "w0", "w", "v", "rank"])


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, **options) -> Model:
    """The model of the labelled rows outside fold 0; at most ``sample`` of them, by the hash of the id.

    Rows with a null label or id aren't learnt from; a document labelled twice
    counts twice. Documents that would take the sample beyond ``SAMPLE_BUCKETS``
    are left to scoring alone. No labels, or an empty table: a model that says no.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("__id is not null and toxic is not null").where(fold(F.col("__id")) != 0)
    picked = rows.orderBy(F.xxhash64("__id"), "__id", "toxic").limit(sample)
    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    joined = text.join(F.broadcast(picked), "__id").select("__id", "toxic", "__text")  # at most ``sample`` rows of two numbers
    bits = options.get("bits", BITS)
    scratch = Scratch(docs.sparkSession, "toxicity")
    table = scratch.table(map_batches(joined, _bucket_rows, "id long, toxic int, buckets binary", bits), "sample")
    # rows up to the bound, found from their sizes: the window is over the sample's rows alone
    size = F.octet_length("buckets").cast("long")
    key = table.select("id", F.xxhash64("id").alias("o"), size.alias("n")).groupBy("o", "id").agg(F.sum("n").alias("n"))
    within = key.withColumn("upto", F.sum("n").over(W.orderBy("o", "id").rowsBetween(W.unboundedPreceding, 0))).where(F.col("upto") <= 4 * SAMPLE_BUCKETS).select("id")
    # fitted where the rows are: neither they nor what the fit holds come to the driver, which has other work's memory to keep
    sampled = table.join(F.broadcast(within), "id").select("toxic", "buckets").coalesce(1)
    found = map_batches(sampled, _fitted, "bits int, active binary, w0 double, w binary, v binary, rank int", options).collect()
    model = Model(m.bits, np.frombuffer(m.active, np.uint32), m.w0, np.frombuffer(m.w, np.float64), np.frombuffer(m.v, np.float64).reshape(-1, m.rank)) if (m := next(iter(found), None)) else train([], **options)  # Spark leaves out a task over nothing
    scratch.drop(table)
    return model


class Scorer:
    """Scores texts; remembers, within bounds, where each term leads."""

    def __init__(self, model: Model):
        self.model, self.mask = model, (1 << model.bits) - 1
        self.place = {int(b): i for i, b in enumerate(model.active)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of(self, text: bytes | None) -> float:
        found, known = set(), self.known
        for w in terms(text or b""):
            places = known.get(w)
            if places is None:
                if len(known) >= _Buckets.LIMIT:
                    known.clear()
                at = (self.place.get(xxhash.xxh3_64_intdigest(f) & self.mask) for f in features(w))
                known[w] = places = tuple(i for i in at if i is not None)
            found.update(places)
        return self.model.score(np.array(sorted(found), np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row. A null or empty text has no terms and gets the base score."""
    rows = binary_text(docs, [F.col(id_col).cast("long").alias("doc_id")], text_col)
    held = docs.sparkSession.sparkContext.broadcast(model.parts())  # buckets that take part, of RANK + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(scores(batches))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*held.value))
        for b in chunked(batches, 8 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.of(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; all their columns, whatever their names, scored beside their text in one pass.

    Null and empty texts get the base score; repeated rows stay or go together; an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.parts())
    rows = packed(docs)
    plain = rows.select("row", F.col(f"row.`{text_col}`").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(kept(batches))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*held.value))
        for b in chunked(batches, 8 << 20):
            keep = pa.array([scorer.of(t.as_py()) < 0.5 for t in b.column(1)], pa.bool_())
            yield b.select([0]).filter(keep)

    return unpacked(plain.mapInArrow(run, rows.schema), docs)
