"""Writers: wire rows, Markdown export, backup with a manifest, replay bundles."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import need

MANIFEST = "_manifest"
MARK = "<!-- colloquy export -->"


def wire_rows(turns: DataFrame) -> DataFrame:
    """(id, json): a stable row for clients. Nanoseconds go as text, beside milliseconds as a number; null fields stay."""
    both = []
    for c in turns.columns:
        if c.endswith("_ns"):
            both += [F.col(c).cast("string").alias(c), F.expr(f"{c} div 1000000").alias(c[:-3] + "_ms")]
        else:
            both.append(F.col(c))
    return turns.select("id", F.to_json(F.struct(*both), {"ignoreNullFields": "false"}).alias("json"))


def export_plan(turns: DataFrame, tz: str = "UTC") -> DataFrame:
    """local_day, turns, conversations: what a Markdown export would write."""
    return _days(turns, tz).groupBy("local_day").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("thread_id").alias("conversations"))


def _days(turns: DataFrame, tz: str) -> DataFrame:
    stamp = F.from_utc_timestamp(F.timestamp_micros(F.expr("t_start_ns div 1000")), tz)
    return turns.withColumn("local_time", stamp).withColumn("local_day", F.to_date(stamp))


def export_markdown(turns: DataFrame, path: str, tz: str = "UTC", places: DataFrame | None = None) -> None:
    """Writes a folder a local day with its lines in order, under headings for conversations.

    Lines are sorted within a day's partition and streamed out, so a day is never
    gathered into one value. ``places`` (world_name, t_start_ns, t_end_ns) names where a conversation began.
    """
    rows = _days(turns, tz)
    if places is not None:
        from ..operators.joins import asof_join

        rows = asof_join(rows.withColumn("__one", F.lit(0)), places.select("world_name", F.col("t_start_ns").alias("v_start"), F.col("t_end_ns").alias("v_end")).withColumn("__one", F.lit(0)), ["__one"], "t_start_ns", "v_start", "v_end")
    else:
        rows = rows.withColumn("world_name", F.lit(None).cast("string"))
    w = W.partitionBy("local_day").orderBy("t_start_ns", "id")
    head = ~F.lag("thread_id").over(w).eqNullSafe(F.col("thread_id")) | F.lag("id").over(w).isNull()
    first = F.lag("id").over(w).isNull()
    line = F.concat(F.lit("- "), F.date_format("local_time", "HH:mm"), F.lit(" **"), F.coalesce(F.col("speaker_id").cast("string"), F.lit("?")), F.lit("** "), F.coalesce("text", F.lit("")))
    title = F.concat(F.lit("\n## "), F.date_format("local_time", "HH:mm"), F.coalesce(F.concat(F.lit(" "), F.col("world_name")), F.lit("")), F.lit("\n"))
    top = F.concat(F.lit(MARK + "\n# "), F.date_format("local_day", "yyyy-MM-dd"), F.lit("\n"))
    text = F.concat(F.when(first, top).otherwise(""), F.when(head, title).otherwise(""), line)
    out = rows.withColumn("value", text).select("local_day", "value", "t_start_ns", "id")
    out.repartition("local_day").sortWithinPartitions("local_day", "t_start_ns", "id").select("local_day", "value").write.partitionBy("local_day").mode("errorifexists").text(path)


def people_sheet(totals: DataFrame, speakers: DataFrame) -> DataFrame:
    """value: a Markdown line a person, most speech first."""
    rows = totals.join(speakers.select(F.col("id").alias("speaker_id"), "display_name"), "speaker_id", "left")
    name = F.coalesce("display_name", F.format_string("Speaker_%02d", "speaker_id"))
    return rows.select(F.concat(F.lit("- "), name, F.lit(": "), F.col("segments").cast("string"), F.lit(" turns, "), F.floor(F.col("speech_ns") / 6e10).cast("string"), F.lit(" min")).alias("value"), "speech_ns", "speaker_id").orderBy(F.col("speech_ns").desc(), "speaker_id").select("value")


def table_digest(df: DataFrame) -> dict:
    """Rows and an order-free digest of a table: the sum of its rows' hashes."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return {"rows": r.n, "digest": str(r.h), "columns": [list(x) for x in df.dtypes]}


def backup(tables: dict[str, DataFrame], path: str, key: bytes, version: int) -> dict:
    """Copies tables and writes a manifest of schema version, rows and digests, signed with a key."""
    spark = next(iter(tables.values())).sparkSession
    body = {"version": version, "tables": {}}
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        body["tables"][name] = table_digest(spark.read.parquet(f"{path}/{name}"))
    text = json.dumps(body, sort_keys=True)
    sign = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    spark.createDataFrame([(text, sign)], "body string, signature string").coalesce(1).write.json(f"{path}/{MANIFEST}")
    return body


def verify_backup(spark: SparkSession, path: str, key: bytes) -> list[str]:
    """What is wrong with a backup; empty if nothing is. Everything is read and counted again."""
    row = spark.read.schema("body string, signature string").json(f"{path}/{MANIFEST}").first()
    if not hmac.compare_digest(hmac.new(key, row.body.encode(), hashlib.sha256).hexdigest(), row.signature):
        return ["the manifest's signature does not hold"]
    wrong = []
    for name, said in json.loads(row.body)["tables"].items():
        try:
            found = table_digest(spark.read.parquet(f"{path}/{name}"))
        except Exception as e:  # a table that can't be read is a finding, not a crash
            wrong.append(f"{name}: {type(e).__name__}")
            continue
        wrong += [f"{name}: {k} differ" for k in said if said[k] != found[k]]
    return wrong


def restore(spark: SparkSession, path: str, key: bytes, target: str, paused: bool) -> None:
    """Writes a verified backup to a new folder; refused while capture runs, and what stood there before is not touched."""
    need(paused, "pause capture before restoring", "refused")
    wrong = verify_backup(spark, path, key)
    need(not wrong, "; ".join(wrong), "conflict")
    body = json.loads(spark.read.schema("body string, signature string").json(f"{path}/{MANIFEST}").first().body)
    for name in body["tables"]:
        spark.read.parquet(f"{path}/{name}").write.mode("errorifexists").parquet(f"{target}/{name}")


def replay_bundle(turns: DataFrame, thread_id: int) -> DataFrame:
    """The turns of one thread in order, with whether their audio is there."""
    return turns.where(F.col("thread_id") == thread_id).select("id", "speaker_id", "t_start_ns", "t_end_ns", "text", F.col("audio_path").isNotNull().alias("has_audio")).orderBy("t_start_ns", "id")
