"""Summaries of hours as records arrive: provisional, final, and corrected by late records.

The stream's watermark is ``late`` behind the latest record, so that long records are taken in. An hour of an owner
closes earlier: once a record is ``grace`` past its end. Both are timers of event time in the state of the
owner: one closes the hour and all before it that are open, with empty rows for the hours between, the
other, when no record of the hour can come any more, forgets it. Each row carries the
hour's revision; the sink keeps the greatest (``windows.upserted`` with ``latest=["revision"]``).

A task sums what it reads by (owner, hour, app) before the shuffle, so an owner with very many records sends few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3600
PROVISIONAL, FINAL, CORRECTED = "provisional", "final", "corrected"
SUMMARY = "owner long, hour long, n long, seconds long, apps string, status string, revision long"
COMBINED = "owner long, hour long, app string, n long, seconds long, end_ts long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what the session must name as spark.sql.streaming.stateStore.providerClass


def combined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of each batch of rows (owner, end_ts, duration, app)."""
    for f in frames:
        f = f.assign(hour=f["end_ts"] // HOUR, app=f["app"].fillna(""))
        by = f.groupby(["owner", "hour", "app"], as_index=False).agg(n=("end_ts", "size"), seconds=("duration", "sum"), end_ts=("end_ts", "max"))
        yield by.astype({"n": "int64", "seconds": "int64"})


def top_apps(sums: dict[str, tuple[int, int]], most: int) -> str:
    """Names by seconds, most first, then by name."""
    return ", ".join(a for a, _ in sorted(sums.items(), key=lambda x: (-x[1][1], x[0]))[:most])


class Hours(StatefulProcessor):
    def __init__(self, late: int, grace: int, most: int):
        self.late, self.grace, self.most = late, grace, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "hour long, app string", "n long, seconds long")
        self.open = handle.getValueState("open", "hour long")  # the first hour that hasn't closed
        self.revisions = handle.getMapState("revisions", "hour long", "revision long")  # of the hours that aren't forgotten

    def close_at(self, hour: int) -> int:
        """The watermark (ms) at which a record is ``grace`` past the hour's end."""
        return ((hour + 1) * HOUR + self.grace - self.late) * 1000

    def forget_at(self, hour: int) -> int:
        return (hour + 1) * HOUR * 1000

    def row(self, owner: int, hour: int, sums: dict[str, tuple[int, int]], status: str) -> tuple:
        revision = (self.revisions.getValue((hour,))[0] if self.revisions.containsKey((hour,)) else 0) + 1
        self.revisions.updateValue((hour,), (revision,))
        return owner, hour, sum(n for n, _ in sums.values()), sum(s for _, s in sums.values()), top_apps(sums, self.most), status, revision

    def held(self) -> dict[int, dict[str, tuple[int, int]]]:
        out: dict[int, dict[str, tuple[int, int]]] = {}
        for (hour, app), (n, seconds) in self.sums.iterator():
            out.setdefault(hour, {})[app] = n, seconds
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touched = set()
        for frame in rows:
            by = frame.groupby(["hour", "app"], as_index=False)[["n", "seconds"]].sum()
            for hour, app, n, seconds in by.itertuples(index=False, name=None):
                place = (int(hour), app)
                old = self.sums.getValue(place) if self.sums.containsKey(place) else (0, 0)
                self.sums.updateValue(place, (old[0] + int(n), old[1] + int(seconds)))
                touched.add(int(hour))
        first = self.open.get()[0] if self.open.exists() else min(touched)
        if not self.open.exists():
            self.open.update((first,))
        held, out = self.held(), []
        for hour in sorted(touched):
            if hour >= first:
                self.handle.registerTimer(max(self.close_at(hour), 1))
            self.handle.registerTimer(self.forget_at(hour))
            out.append(self.row(key[0], hour, held[hour], PROVISIONAL if hour >= first else CORRECTED))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in SUMMARY.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held, out = timerValues.getCurrentWatermarkInMs(), self.held(), []
        closing = [h for h in held if self.open.get()[0] <= h and self.close_at(h) <= now]
        if closing:
            for hour in range(self.open.get()[0], max(closing) + 1):
                out.append(self.row(key[0], hour, held.get(hour, {}), FINAL))
                if hour not in held:
                    self.handle.registerTimer(self.forget_at(hour))
            self.open.update((max(closing) + 1,))
        for hour in [h for (h,) in self.revisions.keys() if self.forget_at(h) <= now and h < self.open.get()[0]]:
            for app in held.get(hour, {}):
                self.sums.removeKey((hour, app))
            self.revisions.removeKey((hour,))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in SUMMARY.split(", ")])

    def close(self) -> None:
        pass


def summaries(stream: DataFrame, late: int = 86_400, grace: int = 600, most: int = 3) -> DataFrame:
    """Rows (see SUMMARY) of the hours of a stream (owner, end_ts, duration, app), in output mode ``update``. An owner's hours begin with
    the first that has a record when the owner's state begins; a record of an earlier hour corrects it. Rows
    without owner or end_ts belong to no hour; a null app is the empty name, a null duration 0."""
    rows = stream.where("owner is not null and end_ts is not null").select(F.col("owner").cast("long").alias("owner"), F.col("end_ts").cast("long").alias("end_ts"), F.coalesce(F.col("duration").cast("long"), F.lit(0)).alias("duration"), "app")
    timed = rows.mapInPandas(combined, COMBINED).withColumn("at", F.timestamp_seconds("end_ts")).withWatermark("at", f"{late} seconds")
    return timed.groupBy("owner").transformWithStateInPandas(Hours(late, grace, most), SUMMARY, "update", "eventTime")


def summarised(records: DataFrame, most: int = 3) -> DataFrame:
    """The same rows of all records at once, without status and revision: every hour from an owner's first to its last."""
    rows = records.where("owner is not null and end_ts is not null").select("owner", F.floor(F.col("end_ts") / HOUR).alias("hour"), F.coalesce("app", F.lit("")).alias("app"), F.coalesce("duration", F.lit(0)).alias("duration"))
    by = rows.groupBy("owner", "hour", "app").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"))
    names = F.array_sort(F.collect_list(F.struct((-F.col("seconds")).alias("minus"), "app")))  # a row an app
    full = by.groupBy("owner", "hour").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"), F.array_join(F.transform(F.slice(names, 1, most), lambda x: x["app"]), ", ").alias("apps"))
    every = full.groupBy("owner").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select("owner", F.explode(F.sequence("a", "b")).alias("hour"))
    zero = F.lit(0).cast("long")
    return every.join(full, ["owner", "hour"], "left").select("owner", "hour", F.coalesce("n", zero).alias("n"), F.coalesce("seconds", zero).alias("seconds"), F.coalesce("apps", F.lit("")).alias("apps"))
