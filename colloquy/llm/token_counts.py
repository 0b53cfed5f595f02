"""Offset-mapped token attribution.

Each whole document is encoded once. The tokens' character spans, from their
bytes, are interval-joined with the spans of its sections (lines, with their
line ends), and each token goes to one section by a rule: the section that holds
most of its characters; of two that hold as many, the earlier. A token that ends
within a character begins and ends where that character does not yet count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import binary_text, chunked, trimmed


def allocate(ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, int]:
    """(tokens a section, tokens that cross): tokens tile 0..ends[-1]; ``sections`` are the sections' ends, ascending."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(sections, starts, "right")
    first = np.minimum(first, len(sections) - 1)
    last = np.minimum(np.searchsorted(sections, ends, "left"), len(sections) - 1)
    home = first.copy()
    for i in np.flatnonzero(last > first):
        cuts = np.concatenate([[starts[i]], sections[first[i] : last[i]], [ends[i]]])
        home[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(home, minlength=len(sections)), int((last > first).sum())


def _tokens(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str) -> Iterator[pa.RecordBatch]:
    import tiktoken

    encoding = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for t, i in ranks.items():
        size[i] = len(t)
    for b in chunked(batches, 4 << 20):
        cols = ([], [], [], [], [])
        for t in b.column(1):
            raw = t.as_py() or b""
            ids = np.array(encoding.encode_ordinary(raw.decode("utf-8", "replace")), np.int64)
            # characters begun before each byte: what a byte offset is as a character offset
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            ends = chars[np.minimum(np.cumsum(size[ids]), len(raw))]
            breaks = chars[np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1]
            sections = np.append(breaks, chars[-1]) if not len(breaks) or breaks[-1] < chars[-1] else breaks
            per, crossing = allocate(ends, sections) if len(ids) else (np.zeros(len(sections), np.int64), 0)
            for c, v in zip(cols, (len(ids), len(sections), int(per[0]), crossing, per.tolist()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.int64()))], ["doc_id", "n_tokens", "n_sections", "first_tokens", "n_crossing", "section_tokens"])


def attribute(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_sections, first_tokens, n_crossing, section_tokens: a row for each row.

    A section is a line with its line end; a text that ends with a line end has
    no further, empty line. A null or empty text has one empty section and no
    tokens. The tokens of the sections add up to the document's.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(_tokens(batches, held.value, pattern))

    rows = binary_text(docs, [F.col(id_col).cast("long").alias("doc_id")], text_col)
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_sections long, first_tokens long, n_crossing long, section_tokens array<long>")
