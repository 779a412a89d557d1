"""Parquet tables, and the views of them that the operators work on."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each kind of event counts as.
CATEGORIES = {"error": "development", "view": "browser", "click": "browser", "signup": "communication", "purchase": "entertainment"}
BROWSERS = ("view", "click")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category_of(app: Column) -> Column:
    out = F
    for k, v in CATEGORIES.items():
        out = out.when(app == k, v)
    return out.otherwise("other")


def activities(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Interval records: [start_ts, end_ts) in epoch seconds, stamped at their end. Bounds of
    end_ts (``since`` is inside, ``until`` not) reach the scan as filters on its column."""
    e = read(spark, sf_dir, "events")
    for bound, op in ((since, ">="), (until, "<")):
        if bound is not None:
            at = datetime.fromtimestamp(bound, UTC).strftime("%Y-%m-%d %H:%M:%S")
            e = e.where(f"ts {op} timestamp_ntz'{at}'")
    app = F.col("event_type")
    url = F.when(app.isin(*BROWSERS), F.concat(F.lit("https://site"), F.pmod("user_id", F.lit(7)), F.lit(".example.org/"), app, F.lit("/")))
    return e.select(
        F.col("event_id").alias("id"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("end_ts"), app.alias("app"), F.col("user_id").alias("owner"),
        F.floor("value").cast("long").alias("duration"), url.alias("url"), category_of(app).alias("category"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    ).withColumn("start_ts", F.col("end_ts") - F.col("duration"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages with a direction and a time in milliseconds."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("conversation"), F.col("turn").alias("ordinal"), "role", F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", "self").otherwise("other").alias("direction"), (F.col("turn") * 60000).alias("created_at_ms"),
    )
