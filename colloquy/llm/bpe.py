"""Byte-level BPE over a global distinct-word shuffle.

Pre-tokens are exploded with their positions, each distinct word of the corpus
is encoded once, and the ids join back and are put together by position. Rows
travel packed: a chunk of documents is one row that keeps its pre-tokens as codes
into the chunk's word list, most frequent first. The lists are dealt out by the
hash of the word, so that a word crosses the shuffle once a chunk, not once an
occurrence ("the" in a third of all tokens is one entry a chunk), and all chunks'
entries of one word meet in one partition, which encodes it once. Its ids go back
to the chunks, which are bucketed and so stay where they are. Decoding looks the ids up in the vocabulary, which
every task has by broadcast, and puts the bytes together by position; ``decode``, for ids alone, joins them with the token-byte table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binary_text, chunked, map_batches, trimmed

#: Text bytes of a chunk, which bound its row; words of all chunks' lists that a partition of the shuffle gets.
CHUNK_BYTES, PART_WORDS = 8 << 20, 1_000_000
#: Text bytes of a bucket of chunks, which bound a task; the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 20_000
#: Documents a batch of results.
OUT_ROWS = 256
_CHUNK = "chunk long, ids array<long>, lens binary, codes binary, words binary, n_words long"


class _Codes(dict):
    """value -> its place in the order of first sight."""

    def __missing__(self, value):
        self[value] = n = len(self)
        return n


def _z(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unz(b: bytes) -> bytes:
    n = int.from_bytes(b[:8], "little")
    return pa.Codec("zstd").decompress(b[8:], n, asbytes=True) if n else b""


def pack_numbers(x: np.ndarray) -> bytes:
    """u32 numbers as four byte planes, which compress well where numbers are small."""
    return _z(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(b: bytes) -> np.ndarray:
    raw = np.frombuffer(_unz(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def pack_list(items: list[bytes]) -> bytes:
    lens = pack_numbers(np.fromiter(map(len, items), np.uint32, len(items)))
    return len(lens).to_bytes(8, "little") + lens + _z(b"".join(items))


def unpack_list(b: bytes) -> list[bytes]:
    n = int.from_bytes(b[:8], "little")
    ends, raw = np.cumsum(unpack_numbers(b[8 : 8 + n]), dtype=np.int64).tolist(), _unz(b[8 + n :])
    return [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]


def _parts(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words), np.int64, len(words))


def _pack(batches: Iterator[pa.RecordBatch], pattern: str, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    find = regex.compile(pattern).findall
    base, n = TaskContext.get().partitionId() << 32, 0
    for b in _joined(batches, chunk_bytes):
        codes, parts, ids = _Codes(), [], []
        for i, t in b:
            seq = find(t.decode("utf-8", "replace")) if t else []
            ids.append(i)
            parts.append(np.fromiter(map(codes.__getitem__, seq), np.uint32, len(seq)))
        flat = np.concatenate(parts)
        order = np.argsort(-np.bincount(flat, minlength=len(codes)), kind="stable")  # most frequent first
        rank = np.empty(len(codes), np.uint32)
        rank[order] = np.arange(len(codes), dtype=np.uint32)
        seen = list(codes)
        words = [seen[k].encode() for k in order.tolist()]
        yield _chunk_row(base + n, ids, parts, rank[flat] if len(flat) else flat, words)
        n += 1


def _chunk_row(chunk: int, ids: list, parts: list[np.ndarray], flat: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
    lens = np.fromiter(map(len, parts), np.uint32, len(parts))
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (pack_numbers(lens), pack_numbers(flat), pack_list(words))), pa.array([len(words)], pa.int64())],
        ["chunk", "ids", "lens", "codes", "words", "n_words"],
    )


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """(id, bytes) of rows, in lists of about ``most`` bytes, across batches."""
    rows, size = [], 0
    for b in chunked(batches, most):
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py()
            rows.append((i, t))
            size += len(t or b"")
            if size >= most:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each part of a chunk's word list."""
    for b in batches:
        for chunk, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words = unpack_list(packed.as_py())
            part = _parts(words, parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            own = [(p, pack_list([words[k] for k in order[lo:hi].tolist()])) for p, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.int32()), pa.array([chunk] * len(own), pa.int64()), pa.array([w for _, w in own], pa.binary())], ["part", "chunk", "words"])


def _encoded(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Token ids of the words of each row, a list a word; a word is encoded once a partition, and a partition has all rows of its words."""
    import tiktoken

    # a word is one piece, whatever it holds
    piece = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[bytes, bytes] = {}
    for b in batches:
        parts, chunks = b.column(0), b.column(1)
        for i in range(b.num_rows):
            out = []
            for w in unpack_list(b.column(2)[i].as_py()):
                ids = known.get(w)
                if ids is None:
                    known[w] = ids = np.array(piece(w.decode()), "<u4").tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([parts.slice(i, 1), chunks.slice(i, 1), pa.array([pack_list(out)], pa.binary())], ["part", "chunk", "token_ids"])


def _unpack(batches: Iterator[pa.RecordBatch], parts: int, vocabulary: dict[int, bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """(id, token_ids, decoded) of a chunk's documents from its codes, its words' ids (parts > 0; else the codes are ids) and the tokens' bytes: all, or the chunk's own."""
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(k)[i] for k, n in enumerate(b.schema.names)}
            ids, lens, codes = row["ids"].as_py(), unpack_numbers(row["lens"].as_py()), unpack_numbers(row["codes"].as_py())
            tokens = vocabulary if vocabulary is not None else dict(zip(*(row["tokens"].values.field(k).to_pylist() for k in (0, 1)), strict=True)) if row["tokens"].is_valid else {}
            if parts:
                part = _parts(unpack_list(row["words"].as_py()), parts)
                at = np.argsort(part, kind="stable").tolist()
                lists = sorted(row["dealt"].as_py() or [], key=lambda x: x["part"])
                by_word = [b""] * len(part)
                for k, x in zip(at, (w for p in lists for w in unpack_list(p["token_ids"])), strict=True):
                    by_word[k] = x
                in_bytes = [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in by_word]
            ends = np.cumsum(lens, dtype=np.int64).tolist()
            starts = [0, *ends[:-1]]
            for lo in range(0, len(ids), OUT_ROWS):
                hi = min(lo + OUT_ROWS, len(ids))
                token_ids, decoded = [], []
                for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True):
                    seq = codes[s:e].tolist()
                    token_ids.append(b"".join(map(by_word.__getitem__, seq)) if parts else codes[s:e].tobytes())
                    decoded.append(b"".join(map((in_bytes if parts else tokens).__getitem__, seq)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(token_ids, pa.binary()), pa.array(decoded, pa.binary())], ["id", "token_ids", "decoded"])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_byte_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """(token, bytes), a row for each rank of the vocabulary file: its size is fixed by that file."""
    return spark.createDataFrame([(i, bytearray(t)) for t, i in ranks.items()], "token int, bytes binary")


def _token_bytes(used: DataFrame, table: DataFrame) -> DataFrame:
    """(chunk, tokens): the bytes of each token that a chunk uses; at most the vocabulary a chunk."""
    distinct = used.select("chunk", F.explode("used").alias("token")).distinct()
    return distinct.join(F.broadcast(table), "token").groupBy("chunk").agg(F.collect_list(F.struct("token", "bytes")).alias("tokens"))


def _buckets(rows: DataFrame) -> int:
    """Buckets of chunks for so many bytes of text."""
    size = rows.agg(F.sum(F.octet_length("__text").cast("long"))).first()[0] or 0
    return min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))


_OUT = "id long, token_ids binary, decoded binary"


def encode_decode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, part_words: int = PART_WORDS) -> DataFrame:
    """(id, token_ids, decoded): the token ids of each text (little-endian u32) and the bytes they decode to.

    A row for each row of ``docs``; a null or empty text has no ids and decodes
    to no bytes; repeated rows give repeated rows; other columns, whatever their
    names, are not looked at; an empty table gives an empty table.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "bpe")
    ranks = load_ranks(vocab_path)
    held = spark.sparkContext.broadcast(ranks)  # the vocabulary: 50 thousand entries
    rows = binary_text(docs, [F.col(id_col).cast("long").alias("id")], text_col)
    buckets = _buckets(rows)
    chunks = scratch.bucketed(map_batches(rows, _pack, _CHUNK, pattern, chunk_bytes), "chunk", buckets)
    parts = 1 + (chunks.agg(F.sum("n_words")).first()[0] or 0) // part_words
    parts = max(parts, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(_encoded(batches, held.value))

    dealt = map_batches(chunks.select("chunk", "words"), _dealt, "part int, chunk long, words binary", parts).repartition(parts, "part")
    # no scratch table: the ids are on disk once, as what the shuffle back to the chunks holds
    coded = dealt.mapInArrow(run, "part int, chunk long, token_ids binary")
    # dealt as the chunks are bucketed: with fewer buckets than shuffle partitions, the join would else shuffle the chunks too
    back = coded.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("part", "token_ids")).alias("dealt"))
    whole = chunks.select("chunk", "ids", "lens", "codes", "words").join(back, "chunk", "left")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(_unpack(batches, parts, {i: t for t, i in held.value.items()}))

    return whole.mapInArrow(unpack, _OUT)


def encode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids) of each text."""
    return encode_decode(docs, vocab_path, pattern, id_col, text_col).select("id", "token_ids")


def _pack_ids(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    base, n = TaskContext.get().partitionId() << 32, 0
    for rows in _joined(batches, chunk_bytes):
        parts = [np.frombuffer(t or b"", "<u4") for _, t in rows]
        flat = np.concatenate(parts)
        row = _chunk_row(base + n, [i for i, _ in rows], parts, flat, [])
        yield row.append_column("used", pa.array([np.unique(flat).astype(np.int32)], pa.list_(pa.int32())))
        n += 1


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "id", ids_col: str = "token_ids", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, decoded) of rows of ids: a chunk's ids join the token-byte table, bytes go together by position.

    A null or empty list of ids decodes to no bytes. An id outside the
    vocabulary raises ``KeyError`` on the executor rather than losing bytes.
    """
    spark, scratch = encoded.sparkSession, Scratch(encoded.sparkSession, "unbpe")
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("__text"))
    chunks = scratch.bucketed(map_batches(rows, _pack_ids, _CHUNK + ", used array<int>", chunk_bytes), "chunk", _buckets(rows))
    tokens = _token_bytes(chunks.select("chunk", "used"), token_byte_table(spark, load_ranks(vocab_path)))
    whole = chunks.select("chunk", "ids", "lens", "codes", "words").withColumn("dealt", F.lit(None).cast("array<struct<part:int,token_ids:binary>>")).join(tokens, "chunk", "left")
    return map_batches(whole, _unpack, _OUT, 0).select("id", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        F.col("id").alias("doc_id"),
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
