"""Interval records [start, end): clipping, splitting at hours, union length, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR, DAY = 3600, 86400


def overlap(start: Column, end: Column, lo, hi) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.greatest(F.least(end, hi) - F.greatest(start, lo), F.lit(0))


def clipped(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Records that overlap [lo, hi), cut to it; see ``since`` of sources.tables.activities."""
    inside = df.where((F.col("end_ts") > lo) & (F.col("start_ts") < hi))
    return inside.withColumn("s", F.greatest("start_ts", F.lit(lo))).withColumn("e", F.least("end_ts", F.lit(hi)))


def split(df: DataFrame, step: int, name: str, offset: int = 0) -> DataFrame:
    """One row for each step of time (an hour, a day) that [s, e) touches, cut to it."""
    first, last = (F.floor((x - offset) / step).cast("long") for x in (F.col("s"), F.col("e") - 1))
    rows = df.where("e > s").withColumn(name, F.explode(F.sequence(first, last)))
    at = F.col(name) * step + offset
    return rows.withColumn("s", F.greatest("s", at)).withColumn("e", F.least("e", at + step))


def covered(df: DataFrame, keys: list[str], name: str = "seconds") -> DataFrame:
    """Length of the union of [s, e) by key: each record adds what reaches beyond all before it."""
    before = F.max("e").over(Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.col("e") - F.greatest("s", F.coalesce(before, F.col("s"))), F.lit(0))
    return df.withColumn("_added", added).groupBy(*keys).agg(F.sum("_added").alias(name))


def attributed(df: DataFrame, keys: list[str], winner: list[str]) -> DataFrame:
    """Seconds by key and ``winner`` columns, each moment given to the record that covers it and
    ends last (then: greatest id).

    A sweep over the starts: a record that ends before one begun earlier never wins, so the winner
    from a start to the next one is the running maximum by end, as long as it lasts. Records are
    sorted once and never meet one another, however many overlap."""
    by_start = Window.partitionBy(*keys).orderBy("s")  # the maximum's frame takes in equal starts
    top = F.max(F.struct("end_ts", "id", *winner, "e")).over(by_start)
    swept = df.where("e > s").select(*keys, "s", F.lead("s").over(by_start).alias("next"), top.alias("w"))
    seconds = F.least("w.e", F.coalesce("next", "w.e")) - F.col("s")
    return swept.select(*keys, *[F.col(f"w.{c}").alias(c) for c in winner], seconds.alias("seconds")).where("seconds > 0").groupBy(*keys, *winner).agg(F.sum("seconds").alias("seconds"))
