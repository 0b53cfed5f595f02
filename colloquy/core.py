"""What every operator reads through: visibility, resolved speakers, islands.

Instants are UTC nanoseconds as longs and ranges are half-open. A turn has
``id, thread_id, session_id, source, speaker_id, t_start_ns, t_end_ns, text,
overlap_frac, deleted_at`` as far as an operator needs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NS = 1_000_000_000
DAY_NS = 86_400 * NS
#: The 25 code points that count as white space in "is this text empty?".
WHITE = r"[\u0009-\u000D \u0085   -     　]"


class OperatorError(ValueError):
    """An operator refused its arguments; ``kind`` is one of params, not_found, unavailable, refused, conflict, gone."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def need(ok: bool, message: str, kind: str = "params") -> None:
    if not ok:
        raise OperatorError(kind, message)


def clamp(limit: int | None, default: int, most: int) -> int:
    """A page size: ``default`` if absent, else within 1..most."""
    return default if limit is None else max(1, min(int(limit), most))


def live(turns: DataFrame) -> DataFrame:
    """Rows that are not deleted; a table without ``deleted_at`` has no deleted rows."""
    return turns.where("deleted_at IS NULL") if "deleted_at" in turns.columns else turns


def blank(text: Column) -> Column:
    """Null, empty, or nothing but Unicode white space."""
    return F.coalesce(~text.rlike(f"[^{WHITE[1:-1]}]"), F.lit(True))


def resolve_speakers(turns: DataFrame, speakers: DataFrame, column: str = "speaker_id") -> DataFrame:
    """Reads ``column`` through the tombstones of ``speakers`` (id, merged_into): one hop, as merges never chain.

    Unlabelled turns stay; so do turns whose speaker is not in the table.
    """
    hop = speakers.where("merged_into IS NOT NULL").select(F.col("id").alias(column), F.col("merged_into").alias("__to"))
    return turns.join(hop, column, "left").withColumn(column, F.coalesce("__to", column)).select(*turns.columns)


def flatten_tombstones(speakers: DataFrame, rounds: int = 32) -> DataFrame:
    """(id, canonical_id) with chains of merges followed to their end by pointer jumping: n hops take log2(n) rounds.

    A cycle has no end; its members stay as they point after the last round.
    """
    ids = speakers.select("id", F.coalesce("merged_into", "id").alias("to"))
    for _ in range(rounds):
        nxt = ids.select(F.col("id").alias("to"), F.col("to").alias("then"))
        jumped = ids.join(nxt, "to", "left").select("id", "to", F.coalesce("then", "to").alias("then"))
        moved = not jumped.where(F.col("to") != F.col("then")).isEmpty()
        ids = jumped.select("id", F.col("then").alias("to"))
        if not moved:
            break
    return ids.withColumnRenamed("to", "canonical_id")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows within ``keys``: a row with ``starts`` begins the next run (a null starts nothing)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def exact_median(values: str | Column) -> Column:
    """The median of whole numbers; of an even count, the mean of the middle two cut towards zero. Null if there are none."""
    return F.percentile(values, F.lit(0.5)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))
