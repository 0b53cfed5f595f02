"""Telephony audio columns: mu-law, A-law and IMA ADPCM.

mu-law and A-law expand through lookup tables built from their companding rule;
ADPCM decodes in numpy across blocks (one step of all blocks at a time, as
blocks are independent); what comes out is stored as resampled 16-bit PCM. A
text can be carried as such audio: its bytes are mu-law codes in a WAV file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunked, map_batches

RATE, OUT_RATE, UNIT = 8000, 16000, 64
# The format tags of WAV files.
ALAW_TAG, MULAW_TAG, ADPCM_TAG = 6, 7, 17
# Fixed values of the IMA ADPCM format: index changes by the low three bits of a nibble.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


# Fixed values of the IMA ADPCM format: its 89 step sizes, in order.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """int16 sample of each mu-law code (G.711): complement, sign, exponent, mantissa, bias 132."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """int16 sample of each A-law code (G.711): even bits toggled, sign, exponent, mantissa."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exp, mant = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(exp == 0, mant + 8, (mant + 0x108) << np.maximum(exp - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """int16 samples, a row a block, of mono IMA blocks: int16 predictor, step index, a reserved byte, then nibbles (low first)."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        nibble = (columns[k >> 1] >> (4 * (k & 1))) & 15
        low = (nibble & 7).astype(np.int32)
        step = STEPS[index]
        size = step >> 3
        size += np.where(low & 4, step, 0)
        size += np.where(low & 2, step >> 1, 0)
        size += np.where(low & 1, step >> 2, 0)
        value += np.where(nibble & 8, -size, size)
        np.clip(value, -32768, 32767, out=value)
        index += IMA_INDEX[low]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def resample_double(x: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; the last sample holds."""
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    wide = x.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    if len(x):
        out[-1] = x[-1]
    return out


def wav(payload: bytes, tag: int = MULAW_TAG, rate: int = RATE) -> bytes:
    """A mono 8-bit WAV file; its data are even in number, so no pad byte follows."""
    fmt = struct.pack("<4sIHHIIHHH", b"fmt ", 18, tag, 1, rate, rate, 1, 8, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(payload))
    data = struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(fact) + len(data), b"WAVE") + fmt + fact + data


def wav_data(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, block size, data) of a WAV file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, block = 12, 0, 1
    while at + 8 <= len(media):
        name, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, block = int.from_bytes(media[at + 8 : at + 10], "little"), int.from_bytes(media[at + 20 : at + 22], "little")
        if name == b"data":
            return tag, block, media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunked(batches, 8 << 20):
        media = [wav(payload_of(t.as_py())) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, zeros up to a positive multiple of 64, as mu-law codes of a WAV file.

    A null text is empty. A row for each row; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__text"))
    return map_batches(rows, _store, "doc_id long, n_bytes long, media binary")


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64)


def _features(name: str, pcm: np.ndarray, starts: np.ndarray) -> list[str]:
    """Of each file's samples: their number, mean size, peak and sign changes."""
    n = np.diff(np.append(starts, len(pcm)))
    size = np.abs(pcm.astype(np.int32))
    turns = np.empty(len(pcm), np.int64)
    turns[0] = 0
    turns[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    turns[starts] = 0
    mean, peak, zero = _sums(size.astype(np.int64), starts) // n, np.maximum.reduceat(size, starts), _sums(turns, starts)
    return [f"{name}:{a}:{b}:{c}:{d}" for a, b, c, d in zip(n.tolist(), mean.tolist(), peak.tolist(), zero.tolist(), strict=True)]


def _decode(tag: int, block: int, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """int16 samples of files of one format, one after the other, and how many each has. An ADPCM block that is cut short at the end is left out."""
    if tag == ADPCM_TAG:
        if block < 5:
            raise ValueError(f"ADPCM blocks of {block} bytes")
        whole = [d[: len(d) // block * block] for d in data]
        blocks = np.frombuffer(b"".join(whole), np.uint8).reshape(-1, block)
        return adpcm_decode(blocks).ravel(), np.array([len(d) // block * (2 * (block - 4) + 1) for d in whole], np.int64)
    if tag not in (ALAW_TAG, MULAW_TAG):
        raise ValueError(f"no decoder for WAV format {tag}")
    codes = np.frombuffer(b"".join(data), np.uint8)
    return (ALAW if tag == ALAW_TAG else MULAW)[codes], np.array([len(d) for d in data], np.int64)


def _resampled(samples: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Files' samples at twice the rate, and the edges of the files in them; no file runs into the next."""
    double = resample_double(samples)
    edges = np.concatenate(([0], np.cumsum(2 * n)))
    last = edges[1:][n > 0] - 1
    double[last] = double[last - 1]  # a file's last sample holds
    return double, edges


_NAMES = {ADPCM_TAG: "adpcm", ALAW_TAG: "alaw", MULAW_TAG: "mulaw"}


def _read(batches: Iterator[pa.RecordBatch], with_pcm: bool) -> Iterator[pa.RecordBatch]:
    for b in chunked(batches, 2 << 20, "media"):
        files = [(0, 1, b"") if m is None else wav_data(m) for m in b.column(b.schema.get_field_index("media")).to_pylist()]
        features, pcm, payload = [""] * len(files), [None] * len(files), [None if tag == 0 else d for tag, _, d in files]
        for kind in sorted({f[:2] for f in files if f[0]}):
            at = [i for i, f in enumerate(files) if f[:2] == kind]
            data = [files[i][2] for i in at]
            # bytes in whole units are described as each of the formats; others as what they are
            every = kind[0] == MULAW_TAG and all(len(d) % UNIT == 0 and d for d in data)
            found = []
            for tag, block in [(ADPCM_TAG, UNIT), (ALAW_TAG, 1), (MULAW_TAG, 1)] if every else [kind]:
                double, edges = _resampled(*_decode(tag, block, data))
                some = np.flatnonzero(np.diff(edges))
                words = dict(zip(some.tolist(), _features(_NAMES[tag], double, edges[some]), strict=True)) if len(some) else {}
                found.append([words.get(k, f"{_NAMES[tag]}:0:0:0:0") for k in range(len(at))])
                if with_pcm and (tag, block) == kind:
                    for k, i in enumerate(at):
                        pcm[i] = double[edges[k] : edges[k + 1]].tobytes()
            for k, i in enumerate(at):
                features[i] = "|".join(f[k] for f in found)
        kept = [n for n in b.schema.names if n != "media"]
        cols = [*(b.column(b.schema.get_field_index(n)) for n in kept), pa.array(payload, pa.binary()), pa.array(features, pa.string()), *[pa.array(pcm, pa.binary())] * with_pcm]
        yield pa.RecordBatch.from_arrays(cols, [*kept, "payload", "feature", *["pcm"] * with_pcm])


def read_media(stored: DataFrame, with_pcm: bool = True) -> DataFrame:
    """Every column but ``media``, then payload, feature and (with_pcm) pcm: the stored bytes read back, expanded as their format says, at twice the rate.

    ``feature`` describes the resampled samples: their number, mean size, peak,
    sign changes; of mu-law files of whole units as each of the three formats, of
    others as their own. A null file has a null payload and pcm and no feature;
    what is no WAV file of these formats raises.
    """
    kept = "".join(f"`{n}` {t}, " for n, t in stored.dtypes if n != "media")
    return map_batches(stored, _read, f"{kept}payload binary, feature string" + ", pcm binary" * with_pcm, with_pcm)


def store_pcm(stored: DataFrame, path: str) -> DataFrame:
    """``read_media`` of a column of files written to ``path`` as Parquet, resampled 16-bit PCM included, and read again."""
    read_media(stored).write.option("compression", "zstd").parquet(path)
    return stored.sparkSession.read.parquet(path)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What op7 returns: of the files, which are written as a table, and of what is read back of it. A row for each row of ``docs``; an empty table gives an empty table."""
    written = Scratch(docs.sparkSession, "media").table(store_texts(docs, id_col, text_col), "media")
    stored = written.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return read_media(stored, with_pcm=False).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, octet_length(payload) - {UNIT - 1}, {UNIT})")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
