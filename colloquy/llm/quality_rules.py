"""Host-level quality rules.

Per-document rules give failures; failures are counted by host (the domain of a
page, or the source of a document); each host's failure rate is shrunk towards
an empirical beta prior fitted to all hosts by moments; hosts whose shrunk rate
exceeds the limit fail, and that verdict joins back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, binary_text, chunked, join_hot, map_batches, ngram_hashes

#: Limits of the base rules, the window of the repetition rule, and the host's limit.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, HOST_LIMIT = 20, 30, 8, 0.5
_SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>")
_CONTINUED = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeat_words(h: np.ndarray, window: int) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    if len(h) <= window:
        return 0
    g = ngram_hashes(h, window)
    order = np.argsort(g)
    same = g[order[1:]] == g[order[:-1]]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    if not len(starts):
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes, hashes: WordHash, window: int = WINDOW) -> tuple[int, int, int, int, int]:
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            dup += line in seen
            seen.add(line)
    chars = len(text.translate(None, _SPACE + _CONTINUED))
    return len(words), chars, len(text.translate(None, _SYMBOLS)), dup, _repeat_words(hashes.of(words), window)


def _measures(batches: Iterator[pa.RecordBatch], keep: int, window: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHash()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for b in chunked(batches, 8 << 20):
        rows = np.array([measure(t.as_py() or b"", hashes, window) for t in b.column(keep)], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([*b.columns[:keep], *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(5))], [*b.schema.names[:keep], *names])


def measures(docs: DataFrame, id_col: str = "doc_id", host_col: Column | str = "source", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, host and what the rules look at. A null text has no words; windows are within one text."""
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    rows = binary_text(docs, [F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host")], text_col)
    return map_batches(rows, _measures, f"doc_id long, host string, {MEASURES}", 2, window)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(rows: DataFrame, failed: Column, host_limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, host_rate, host_ok.

    The prior is Beta(a, b) with the mean m and variance v of the hosts' rates
    (moments): a + b = m(1-m)/v - 1, held within [1, 1e6] (v may be 0 or large).
    The rate is (n_failed + a) / (n_docs + a + b). Counting combines before the
    shuffle, so a host with a third of the rows is a few rows a task.
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    # one row of moments: it joins by a constant key, whatever the number of hosts
    m = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).select(F.lit(0).alias("one"), "m", "v")
    strength = F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(1e6))))
    shrunk = (F.col("n_failed") + F.col("m") * F.col("s")) / (F.col("n_docs") + F.col("s"))
    return (
        hosts.withColumn("one", F.lit(0))
        .join(F.broadcast(m), "one")
        .withColumn("s", strength)
        .select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk <= host_limit).alias("host_ok"))
    )


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: Column | str = "source", text_col: str = "text", host_limit: float = HOST_LIMIT) -> DataFrame:
    """A row for each document: the measures, base_failed, its host's numbers, kept.

    Null hosts form one host. Repeated rows count as often as they occur. An
    empty table gives an empty table. A document is kept if it passes the base
    rules and its host passes.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    rows = scratch.table(measures(docs, id_col, host_col, text_col).withColumn("base_failed", base_failed()), "measures")  # read twice, measured once
    rows = rows.withColumn("host_key", F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("-")))
    verdicts = host_verdicts(rows.select(F.col("host_key").alias("host"), "base_failed"), F.col("base_failed"), host_limit).withColumnRenamed("host", "host_key")
    verdicts = scratch.table(verdicts, "hosts", "snappy")
    return join_hot(rows, verdicts, ["host_key"], "n_docs", rows.count()).withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("host_key")
