"""The driver's tables as an archive's tables, in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that says the same."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def turns(spark: SparkSession, sf: str, step_ns: int = 2_000_000_000, char_ns: int = 1_000_000) -> DataFrame:
    """Conversations as turns: user is voice 1, assistant 2, system nobody; time follows the turn's number and length."""
    c = table(spark, sf, "conversations")
    start = F.col("turn") * step_ns
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("thread_id"), (F.col("conv_id") % 10).alias("session_id"), F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).cast("long").alias("speaker_id"),
        start.alias("t_start_ns"), (start + char_ns * F.char_length("text").cast("long")).alias("t_end_ns"), ((F.col("turn") % 3) / 10.0).alias("overlap_frac"), "text",
    )


def turns_sql(step_ns: int = 2_000_000_000, char_ns: int = 1_000_000) -> str:
    return f"""turns AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS thread_id, conv_id % 10 AS session_id,
         CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END::BIGINT AS speaker_id,
         turn * {step_ns} AS t_start_ns, turn * {step_ns} + {char_ns} * length(text) AS t_end_ns,
         (turn % 3) / 10.0 AS overlap_frac, text
  FROM conversations
)"""


def event_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Events as turns: the user speaks, the type is the source, the value is the length in centiseconds."""
    e = table(spark, sf, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    length = F.round(F.col("value") * 100).cast("long") * 10_000_000
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("speaker_id"), F.col("event_type").alias("source"), start.alias("t_start_ns"), (start + length).alias("t_end_ns"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), ((F.col("event_id") % 100) / 100).alias("overlap_frac"), "value")


EVENTS = """ev AS (
  SELECT event_id AS id, user_id AS speaker_id, event_type AS source, epoch_us(ts) * 1000 AS t_start_ns,
         epoch_us(ts) * 1000 + CAST(round(value * 100) AS BIGINT) * 10000000 AS t_end_ns,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::BIGINT AS day, (event_id % 100) / 100 AS overlap_frac, value
  FROM events
)"""
HOUR = 3_600_000_000_000
