"""Row numbers over a whole table without a window over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], parts: int = 64) -> tuple[DataFrame, int]:
    """(df with ``row_no`` from 0 in the order, number of rows).

    The rows are cut into ``parts`` ranges by approximate quantiles of the first
    order column; rows are numbered within a range, and ranges by the counts
    before them. A value that fills a range by itself stays in one.
    """
    first = order[0]
    cuts = df.agg(F.percentile_approx(first, F.array(*(F.lit(k / parts) for k in range(1, parts))), 10_000).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col(first) > F.lit(c)).cast("int")
    rows = df.withColumn("__p", part)
    per = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__k"))
    ahead = per.withColumn("__ahead", F.coalesce(F.sum("__k").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__ahead")
    inside = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    out = rows.withColumn("__i", inside).join(F.broadcast(ahead), "__p").withColumn("row_no", (F.col("__i") + F.col("__ahead")).cast("long")).drop("__p", "__i", "__ahead")
    return out, sum(r["__k"] for r in per.collect())
