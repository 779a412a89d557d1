"""Days and hours of a time zone over epoch seconds, safe where clocks change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def local(epoch: Column, zone: str) -> Column:
    """The zone's wall clock, as a timestamp without a zone; the session's zone plays no part."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.expr(EPOCH) + F.make_dt_interval(secs=epoch.cast("decimal(18,6)")))


def epoch_of(wall: Column, zone: str) -> Column:
    """Epoch seconds of a wall clock's time (without a zone); one that is skipped counts as an hour
    later, and of one that comes twice the earlier counts."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH), F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))


def local_date(epoch: Column, zone: str) -> Column:
    return F.to_date(local(epoch, zone)).cast("string")


def day_start(epoch: Column, zone: str) -> Column:
    """Epoch seconds of the local midnight before."""
    return epoch_of(F.to_date(local(epoch, zone)).cast("timestamp_ntz"), zone)


def next_hour(epoch: Column, zone: str) -> Column:
    """The next full hour of the wall clock, also in zones whose offset is no whole hour."""
    wall = local(epoch, zone)
    return epoch + 3600 - (F.minute(wall) * 60 + F.second(wall)).cast("long")
