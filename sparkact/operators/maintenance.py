"""Statistics kept up to date by what changed, instead of being made anew.

A change is a record with a sign: 1 for one that came, -1 for one that went; a record that was re-classified goes in
its old form and comes in its new one. Sums take the signed sums of the changes. The covered time of an hour is no sum
(records overlap), so it is computed again, for the hours of an owner that a change touches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkact.functions.intervals import DAY, HOUR, covered, split

SIGN = "sign"
USAGE = ["owner", "day", "app", "category"]


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Records (owner, id, app, category, start_ts, end_ts, duration) with their signs. Repeated rows count as often."""
    parts = [(d, s) for d, s in ((inserted, 1), (deleted, -1)) if d is not None]
    if not parts:
        raise ValueError("no changes")
    names = ["owner", "id", "app", "category", "start_ts", "end_ts", "duration"]
    rows = [d.select(*names, F.lit(s).alias(SIGN)) for d, s in parts]
    return rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0]


def reclassified(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes of records whose app or category is now another; rows that are the same in both cancel out."""
    return changes(new, old)


def usage(signed: DataFrame) -> DataFrame:
    """(owner, day, app, category, n, seconds) of signed records."""
    day = F.floor(F.col("end_ts") / DAY).alias("day")
    by = signed.groupBy("owner", day, "app", "category")
    return by.agg(F.sum(SIGN).alias("n"), F.sum(F.col(SIGN) * F.coalesce("duration", F.lit(0))).alias("seconds"))


def updated_usage(old: DataFrame, signed: DataFrame) -> DataFrame:
    """``old`` (as of :func:`usage`) after the changes; what has no record left goes. The changes are summed before
    they meet the old rows, so a key with very many changes is one row."""
    both = old.select(*USAGE, "n", "seconds").unionByName(usage(signed))
    return both.groupBy(*USAGE).agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds")).where("n <> 0")


def hours_of(records: DataFrame) -> DataFrame:
    """Records by the hours that they touch, cut to them; see intervals.split."""
    return split(records.withColumns({"s": F.col("start_ts"), "e": F.col("end_ts")}), HOUR, "hour")


def covered_hours(records: DataFrame) -> DataFrame:
    """(owner, hour, seconds): the length of the union of the records in each hour."""
    return covered(hours_of(records).select("owner", "hour", "s", "e"), ["owner", "hour"])


def updated_covered(old: DataFrame, records: DataFrame, signed: DataFrame) -> DataFrame:
    """``old`` (owner, hour, seconds) after the changes, of which ``records`` are the result: only the records of
    touched hours are looked at. An hour without records goes."""
    touched = hours_of(signed).select(F.col("owner").alias("_o"), F.col("hour").alias("_h")).distinct()
    hit = lambda d: F.col("owner").eqNullSafe(F.col("_o")) & (F.col("hour") == F.col("_h"))
    kept = old.join(touched, hit(old), "left_anti").select("owner", "hour", "seconds")
    now = hours_of(records).select("owner", "hour", "s", "e").join(touched, hit(records), "left_semi")
    return kept.unionByName(covered(now, ["owner", "hour"]).select("owner", "hour", "seconds"))


def documents(sums: DataFrame) -> DataFrame:
    """(owner, day, total, apps): one nested document a day and owner from sums by app, most seconds first."""
    by = sums.groupBy("owner", "day", "app").agg(F.sum("seconds").alias("seconds"), F.sum("n").alias("n"))
    apps = F.array_sort(F.collect_list(F.struct((-F.col("seconds")).alias("minus"), "app", "n")))  # a row an app
    shown = F.transform(apps, lambda a: F.struct(a["app"].alias("app"), (-a["minus"]).alias("seconds"), a["n"].alias("n")))
    return by.groupBy("owner", "day").agg(F.sum("seconds").alias("total"), shown.alias("apps"))


def updated_documents(old: DataFrame, sums: DataFrame, signed: DataFrame) -> DataFrame:
    """``old`` documents with those of touched days made anew from ``sums``, which are up to date."""
    touched = signed.select(F.col("owner").alias("_o"), F.floor(F.col("end_ts") / DAY).alias("_d")).distinct()
    hit = F.col("owner").eqNullSafe(F.col("_o")) & F.col("day").eqNullSafe(F.col("_d"))
    return old.join(touched, hit, "left_anti").unionByName(documents(sums.join(touched, hit, "left_semi")))
