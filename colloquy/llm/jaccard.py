"""N-gram Jaccard self-join with a token-group matrix.

Texts become sets of 64-bit shingle hashes. Equal sets are one class. Classes
are partitioned into groups of similar sets: stars around leaders that share a
min-hash, each member verified. The matrix holds each group's token union, as
rows (token, group). A query group's overlap with another group is bounded from
the matrix; only pairs of groups that pass the bound are opened, first through
one witness a token, then, if still apart, in full. Every link that counts is
verified on whole sets, and the bounds lose none:

* prefix: two sets that link share one of the first n - ceil(t n) + 1 tokens of
  each, in any one order of all tokens; the matrix holds these tokens;
* overlap: if c tokens are shared by two such prefixes, the sets share at most
  c + max(ceil(t n1), ceil(t n2)) - 1 tokens, and a link needs ceil(t/(1+t) (n1 + n2)).

The order puts tokens that many sets have last, so that common passages and
lines seldom are candidates; it is a matter of speed alone. Groups that are
linked already need no opening, so a group of near copies costs no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, WordHash, binary_text, chunked, join_hot, map_batches, mix64, ngram_hashes, small, sorted_distinct, trimmed
from .components import components

#: Words of a shingle; a link needs NUM / DEN of the union.
SHINGLE, NUM, DEN = 5, 4, 5
#: Min-hash keys a set for the stars; the most tokens whose frequency the order knows.
KEYS, FREQUENT = 6, 1 << 16
#: Text bytes of a block within which shared tokens are counted for the order.
BLOCK_BYTES = 24 << 20
_SEEDS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: bytes, hashes: WordHash, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of its whole word sequence if that is shorter."""
    return sorted_distinct(ngram_hashes(hashes.of(text.lower().split()), n))


def least_overlap(a, b):
    """Tokens that sets of these sizes must share to link (numbers or arrays)."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _first(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Sizes and digests; and, a row a block, tokens that two or more different sets of the block have."""
    hashes, seen, size = WordHash(), {}, 0
    for b in chunked(batches, 8 << 20):
        sizes, digests = [], []
        for t in b.column(1):
            t = t.as_py() or b""
            s = shingles(t, hashes, n)
            d = _digest(s)
            seen.setdefault(d, s)
            size += len(t)
            sizes.append(len(s))
            digests.append(d)
        k = len(sizes)
        yield _first_rows(b.column(0), sizes, digests, [None] * k, [None] * k)
        if size >= BLOCK_BYTES:
            yield _shared(seen)
            seen, size = {}, 0
    if seen:
        yield _shared(seen)


def _shared(seen: dict[bytes, np.ndarray]) -> pa.RecordBatch:
    every = np.sort(np.concatenate(list(seen.values())))
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(every)))
    many = counts > 1
    return _first_rows(pa.nulls(1, pa.int64()), [None], [None], [every[starts][many].view(np.int64)], [counts[many].astype(np.int32)])


def _first_rows(docs: pa.Array, sizes: list, digests: list, tokens: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [docs, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
        ["doc", "n", "digest", "tokens", "counts"],
    )


class Order:
    """Rank of a token: 0, or for frequent ones 1, 2, ... from the rarest up."""

    def __init__(self, tokens: list[int]):
        t = np.array(tokens, np.int64).view(np.uint64)  # from the rarest up
        self.at = np.argsort(t)
        self.tokens, self.at = t[self.at], self.at + 1

    def ranks(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(s), np.int64)
        i = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[i] == s, self.at[i], 0)


def _second(batches: Iterator[pa.RecordBatch], n: int, order: Order, keys: int) -> Iterator[pa.RecordBatch]:
    """Of each set that is new to its block: size, how many frequent tokens, min-hash keys, prefix."""
    hashes = WordHash()
    for b in chunked(batches, 8 << 20):
        seen, cols = set(), ([], [], [], [], [])
        for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = shingles(t.as_py() or b"", hashes, n)
            if not len(s) or (d := (_digest(s), doc)) in seen:
                continue
            seen.add(d)
            ranks = order.ranks(s)
            p = len(s) - -(-NUM * len(s) // DEN) + 1
            best = np.lexsort((s, ranks))[:p] if ranks.any() else np.arange(p)
            mins = [(s ^ seed).min() for seed in _SEEDS[:keys]]  # hashes already: another order each
            for c, v in zip(cols, (doc, len(s), int((ranks > 0).sum()), np.array(mins, np.uint64).view(np.int64), s[best].view(np.int64)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int64()))],
            ["doc", "n", "frequent", "keys", "prefix"],
        )


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    for b in chunked(batches, 8 << 20):
        rows = {}
        for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows[doc, shingles(t.as_py() or b"", hashes, n).tobytes()] = None  # repeated rows once a block
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc", "set"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            i = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[i] == x).sum())
            keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


class _Verifier:
    """Verifies pairs (a, b) on whole sets, which are made anew for the documents in question."""

    def __init__(self, texts: DataFrame, reps: DataFrame, scratch: Scratch, n: int):
        self.texts, self.reps, self.scratch, self.n = texts, reps, scratch, n

    def links(self, pairs: DataFrame) -> DataFrame:
        pairs = self.scratch.table(pairs.select("a", "b").distinct(), "pairs")
        ids = small(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), 1_000_000)  # 16 MB at most
        # an id stands for all its texts: a pair links if any of them do
        sets = self.scratch.table(map_batches(self.texts.join(ids, "doc", "left_semi"), _sets, "doc long, set binary", self.n), "sets")
        x, y = sets.select(F.col("doc").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc").alias("b"), F.col("set").alias("y"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        out = self.scratch.table(map_batches(both, _linked, "a long, b long").distinct(), "links")
        self.scratch.drop(sets)
        self.scratch.drop(pairs)
        return out


def _fits(a: Column, b: Column) -> Column:
    return (DEN * a >= NUM * b) & (DEN * b >= NUM * a)


def _stars(sig: DataFrame) -> DataFrame:
    """Pairs (a, b): a set and the leader, for some key, of those that share it; the leader has most frequent tokens."""
    keyed = sig.select("doc", "n", "frequent", F.posexplode("keys").alias("k", "key"))
    leaders = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("members"), F.max_by(F.struct("doc", "n"), F.struct("frequent", "n", "doc")).alias("l")).where("members > 1")
    return keyed.join(leaders, ["k", "key"]).where(F.col("doc") != F.col("l.doc")).where(_fits(F.col("n"), F.col("l.n"))).select(F.col("doc").alias("a"), F.col("l.doc").alias("b"))


def _needed(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Prefix tokens that groups with sizes a1..a2 and b1..b2 must share at least if any of their members link."""
    least = F.ceil(NUM * (a1 + b1) / F.lit(NUM + DEN))
    rest = F.ceil(NUM * F.greatest(a2, b2) / F.lit(DEN))
    return F.greatest(F.lit(1), least - rest + 1)


def link_classes(texts: DataFrame, scratch: Scratch, n: int = SHINGLE, keys: int = KEYS, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, reps, comps): every row's (doc, n, digest); (digest, rep) of each class; (node, comp) of linked classes.

    ``texts``: doc, __text.
    """
    first = scratch.table(map_batches(texts, _first, "doc long, n long, digest binary, tokens array<long>, counts array<int>", n), "first")
    meta = first.where("digest is not null").select("doc", "n", "digest")
    reps = meta.where("n > 0").groupBy("digest").agg(F.min("doc").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    counts = first.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select("x.tokens", "x.counts").groupBy("tokens").agg(F.sum("counts").alias("c"))
    # the order's table: ``frequent`` numbers at most, whatever the input
    top = [r.tokens for r in counts.where("c > 15").orderBy(F.col("c").desc(), "tokens").limit(frequent).collect()][::-1]
    held = texts.sparkSession.sparkContext.broadcast(top)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(_second(batches, n, Order(held.value), keys))

    rows = texts.mapInArrow(second, "doc long, n long, frequent long, keys array<long>, prefix array<long>")
    sig = scratch.table(rows.join(reps.where("rep is not null").select(F.col("rep").alias("doc"), "n").distinct(), ["doc", "n"], "left_semi"), "signatures")
    verifier = _Verifier(texts, reps, scratch, n)

    links = verifier.links(_stars(sig))
    stars = components(links, scratch)
    base = sig.select("doc", "n", "prefix").join(stars.withColumnRenamed("node", "doc"), "doc", "left")
    matrix = scratch.table(_matrix(base, sig, stars), "matrix")
    opened = scratch.table(_qualifying(matrix), "open")
    several = (F.col("members_a") > 1) | (F.col("members_b") > 1)
    single = F.array(F.struct(F.col("comp_a").alias("doc_a"), F.col("comp_b").alias("doc_b")))
    witnesses = opened.select(F.explode(F.when(several, F.col("witnesses")).otherwise(single)).alias("p")).select(F.col("p.doc_a").alias("a"), F.col("p.doc_b").alias("b"))
    comps = _joined(stars, verifier.links(witnesses), scratch)
    # groups with several members that one witness a token did not link are opened in full, unless they came together otherwise
    now = comps.select(F.col("node"), F.col("comp").alias("now"))
    left = opened.where(several).select("comp_a", "comp_b", "members_a", "members_b", "c")
    for side in ("a", "b"):
        left = left.join(now.select(F.col("node").alias(f"comp_{side}"), F.col("now").alias(f"now_{side}")), f"comp_{side}", "left")
    left = scratch.table(left.where(F.coalesce("now_a", "comp_a") != F.coalesce("now_b", "comp_b")).select("comp_a", "comp_b", "members_a", "members_b", "c"), "left")
    if not left.isEmpty():
        comps = _joined(comps, verifier.links(_members(base, matrix, left)), scratch)
    # a document with several texts is one node: the classes of its texts are linked through it
    twofold = meta.where("n > 0 AND doc IS NOT NULL").groupBy("doc").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc")
    same = meta.where("n > 0").join(small(twofold), "doc", "left_semi").join(reps.select("digest", "rep"), "digest").select(F.col("doc").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    comps = _joined(comps, scratch.table(same, "same", "snappy"), scratch)
    scratch.drop(sig, matrix, opened, left)
    return meta, reps, comps


def _joined(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components with more links."""
    if links.isEmpty():
        return comps
    return components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(links), scratch)


def _matrix(base: DataFrame, sig: DataFrame, stars: DataFrame) -> DataFrame:
    """token, comp, the group's sizes n1..n2 and members, doc: a member that has the token. Only tokens of two or more groups."""
    sizes = stars.join(sig.select(F.col("doc").alias("node"), "n"), "node").groupBy("comp").agg(F.min("n").alias("n1"), F.max("n").alias("n2"), F.countDistinct("node").alias("members"))
    many = base.where("comp is not null").join(sizes, "comp").select("comp", "doc", "n1", "n2", "members", F.explode("prefix").alias("token"))
    alone = base.where("comp is null").select(F.explode("prefix").alias("token"), F.col("doc").alias("comp"), F.col("n").alias("n1"), F.col("n").alias("n2"), F.lit(1).cast("long").alias("members"), "doc")
    # the members of a group come together before tokens are dealt out, so no token has more rows than groups
    union = many.groupBy("token", "comp", "n1", "n2", "members").agg(F.min("doc").alias("doc")).unionByName(alone)
    token = W.partitionBy("token")
    return union.withColumn("lo", F.min("comp").over(token)).withColumn("hi", F.max("comp").over(token)).where("lo < hi").drop("lo", "hi")


def _qualifying(matrix: DataFrame) -> DataFrame:
    """Pairs of groups whose overlap in the matrix passes the bound; witnesses for groups with several members."""
    a = matrix.select("token", *(F.col(c).alias(f"{c}_a") for c in matrix.columns if c != "token"))
    b = matrix.select("token", *(F.col(c).alias(f"{c}_b") for c in matrix.columns if c != "token"))
    shared = a.join(b, "token").where("comp_a < comp_b").where((DEN * F.col("n2_a") >= NUM * F.col("n1_b")) & (DEN * F.col("n2_b") >= NUM * F.col("n1_a")))
    witness = F.when((F.col("members_a") > 1) | (F.col("members_b") > 1), F.struct("doc_a", "doc_b"))
    bound = shared.groupBy("comp_a", "comp_b", "n1_a", "n2_a", "n1_b", "n2_b", "members_a", "members_b").agg(F.count(F.lit(1)).alias("c"), F.collect_set(witness).alias("witnesses"))
    return bound.where(F.col("c") >= _needed(F.col("n1_a"), F.col("n2_a"), F.col("n1_b"), F.col("n2_b")))


def _members(base: DataFrame, matrix: DataFrame, left: DataFrame) -> DataFrame:
    """Pairs of members (a, b) of the pairs of groups ``left`` that the bounds on their own prefixes leave.

    For two sizes the overlap o that a link needs is known, so two sets that link
    share a token among the first n - o + 1 of each, which are fewer than the
    whole prefixes: in an order with common tokens last, near copies hardly meet
    by what they all have. The smaller group's tokens look for the larger's. Two
    groups that share more tokens than they have pairs of members are opened pair
    by pair instead, which is fewer rows.
    """
    few = F.col("members_a") * F.col("members_b") <= F.col("c")
    pairwise, left = left.where(few), left.where(~few)
    fewer = F.col("members_a") <= F.col("members_b")
    sides = left.select(F.when(fewer, F.col("comp_a")).otherwise(F.col("comp_b")).alias("gx"), F.when(fewer, F.col("comp_b")).otherwise(F.col("comp_a")).alias("gy"))
    inside = sides.select(F.col("gx").alias("comp")).unionByName(sides.select(F.col("gy").alias("comp"))).distinct()
    own = base.withColumn("comp", F.coalesce("comp", "doc")).join(inside, "comp", "left_semi")
    member = own.select("comp", "doc", "n", F.posexplode("prefix").alias("pos", "token"))
    near = member.join(matrix.join(inside, "comp", "left_semi").select("token").distinct(), "token", "left_semi")
    x = near.select(F.col("comp").alias("gx"), F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), "token")
    y = near.select(F.col("comp").alias("gy"), F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), "token")
    met = sides.join(x, "gx").join(y, ["gy", "token"]).where(_fits(F.col("n_a"), F.col("n_b")) & _tight())
    inner = base.withColumn("comp", F.coalesce("comp", "doc")).select("comp", "doc", "n", "prefix")
    of = lambda side: inner.select(F.col("comp").alias(f"comp_{side}"), F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("prefix").alias(f"p_{side}"))
    opened = pairwise.join(of("a"), "comp_a").join(of("b"), "comp_b").where(_fits(F.col("n_a"), F.col("n_b")))
    opened = opened.where(F.size(F.array_intersect("p_a", "p_b")) >= _needed(F.col("n_a"), F.col("n_a"), F.col("n_b"), F.col("n_b")))
    return met.select("a", "b").unionByName(opened.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tight() -> Column:
    """Whether a token that two sets share stands early enough in both to be the first they share if they link."""
    o = F.ceil(NUM * (F.col("n_a") + F.col("n_b")) / F.lit(NUM + DEN))
    return (F.col("pos_a") <= F.col("n_a") - o) & (F.col("pos_b") <= F.col("n_b") - o)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of ``docs``.

    Texts without words (null, empty, white space) have no shingles and are
    linked with nothing: their component is their own id. Rows with one id are
    one document, linked through any of their texts. Rows whose id is null are
    linked with nothing that has an id unless a row with an id has the same set;
    alone, their component is null. Repeated rows stay. An empty table gives an
    empty table.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = binary_text(docs, [F.col(id_col).cast("long").alias("doc")], text_col)
    meta, reps, comps = link_classes(texts, scratch, n)
    # the verdict of each class is found first; the rows of a class with very many copies stay where they are
    classes = reps.select("digest", "rep", "rows").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    classes = Scratch(docs.sparkSession, "classes").table(classes.select("digest", "rows", F.coalesce("comp", "rep").alias("component_id")), "classes", "snappy")
    known = join_hot(meta.where("n > 0"), classes, ["digest"], "rows", meta.count())
    known = known.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return known.unionByName(meta.where("n = 0").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one whose id is the component's.

    Texts without words stay, and so do rows without an id. A document is all
    rows of its id: where it stays, its repeated rows stay with it.
    """
    scratch = Scratch(docs.sparkSession, "keepone")
    found = scratch.table(groups(docs), "groups")
    lost = found.where("component_id < doc_id").select("doc_id").distinct()
    once = docs.join(small(lost, 1_000_000), "doc_id", "left_anti")
    return once
