"""Structured Streaming forms: hourly windows with late data, and the capture merge with state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MERGED = "owner long, app string, seconds long, end_ts long, n long"
STATE = "app string, seconds long, end_ts long, n long, ends array<long>, ids array<long>, apps array<string>, durations array<long>"


def hourly(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Records and seconds by hour and kind; an hour is final once the watermark has passed it."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", delay)
    by = timed.groupBy(F.window("_t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("seconds"))
    return by.select(F.col("w.start").alias("hour"), "event_type", "n", "seconds")


def merged(stream: DataFrame, gap: int = 600, delay: str = "10 minutes") -> DataFrame:
    """Runs of one app of each owner whose records follow within ``gap`` seconds, as one row each.
    Columns of the stream: owner, id, app, duration, end_ts (seconds).

    Records wait in the state until the watermark, ``delay`` behind the latest ``end_ts``, has
    reached them, and are merged in the order of (end_ts, id), however they arrive; later ones are
    dropped. A run is emitted when the next one begins or the watermark is ``gap`` past its end;
    an owner without records and runs leaves the state."""
    waiting = ["end_ts", "id", "app", "duration"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, held = None, []
        if state.exists:
            app, seconds, end, n, *columns = state.get
            run = [app, seconds, end, n] if n else None
            held = list(zip(*columns, strict=True))
        for frame in frames:
            held.extend(frame[waiting].itertuples(index=False, name=None))
        held.sort(key=lambda r: r[:2])
        reached = state.getCurrentWatermarkMs()
        ready = sum(r[0] * 1000 <= reached for r in held)
        out = []
        for end, _, app, duration in held[:ready]:
            if run and run[0] == app and end - run[2] <= gap:
                run = [app, run[1] + int(duration), max(run[2], int(end)), run[3] + 1]
            else:
                if run:
                    out.append((key[0], *run))
                run = [app, int(duration), int(end), 1]
        held = held[ready:]
        if run and (run[2] + gap) * 1000 <= reached:
            out.append((key[0], *run))
            run = None
        if run or held:
            ends, ids, apps, durations = zip(*held, strict=True) if held else ((), (), (), ())
            state.update((*(run or ["", 0, 0, 0]), [int(x) for x in ends], [int(x) for x in ids], list(apps), [int(x) for x in durations]))
            state.setTimeoutTimestamp(int(ends[0]) * 1000 if held else (run[2] + gap) * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["owner", "app", "seconds", "end_ts", "n"])

    timed = stream.select("owner", "id", "app", "duration", "end_ts", F.timestamp_seconds("end_ts").alias("at")).withWatermark("at", delay)
    return timed.groupBy("owner").applyInPandasWithState(step, MERGED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def upserted(path: str, keys: list[str], latest: Sequence[str] = ()):
    """A foreachBatch function that keeps the latest row of each key (by the columns ``latest``
    inside a batch) in a Parquet folder, one version folder after another; a batch that is run
    again leaves its version as it is."""

    def write(batch: DataFrame, number: int) -> None:
        from sparkact.catalog import Catalog

        Catalog(batch.sparkSession, path).upsert(batch, keys, number + 1, latest)

    return write
