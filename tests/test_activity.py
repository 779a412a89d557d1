"""Interval statistics on records written by hand: stamps are interval ends."""

from sparkact.functions.intervals import clipped
from sparkact.operators import activity as act

HOUR, DAY = 3600, 86400
SCHEMA = "id long, end_ts long, app string, owner long, duration long, url string, category string, k long, start_ts long"


def acts(spark, *rows):
    """Rows of (end_ts, duration, app)."""
    return spark.createDataFrame([(i, end, app, 1, length, None, "development", 0, end - length) for i, (end, length, app) in enumerate(rows)], SCHEMA)


def as_map(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_overlap_counts_once(spark):
    a = acts(spark, (10 * HOUR + 1800, 1800, "x"), (10 * HOUR + 2400, 1800, "y"))
    assert as_map(act.hourly_covered(a), "hour", "seconds") == {10: 2400}


def test_no_hour_has_more_than_its_seconds(spark):
    a = acts(spark, *[(11 * HOUR, 3000 + 10 * i, f"a{i}") for i in range(9)])
    assert max(as_map(act.hourly_covered(a), "hour", "seconds").values()) <= HOUR


def test_records_are_split_at_hours(spark):
    assert as_map(act.hourly_covered(acts(spark, (11 * HOUR + 600, 1200, "x"))), "hour", "seconds") == {10: 600, 11: 600}


def test_hours_of_several_days_merge(spark):
    a = acts(spark, (10 * HOUR + 60, 60, "x"), (DAY + 10 * HOUR + 90, 90, "x"))
    got = as_map(act.hour_of_day(a), "h", "seconds")
    assert len(got) == 24 and got[10] == 150 and sum(got.values()) == 150


def test_attribution_is_the_covered_time(spark):
    a = acts(spark, (10 * HOUR + 1000, 900, "x"), (10 * HOUR + 1500, 1000, "y"), (10 * HOUR + 3000, 100, "x"))
    given = act.hour_app_attribution(a).groupBy("hour").sum("seconds").collect()[0][1]
    assert given == as_map(act.hourly_covered(a), "hour", "seconds")[10]


def test_days_are_clipped_at_both_edges(spark):
    a = acts(spark, (DAY + 100, 300, "x"), (2 * DAY + 50, 80, "x"), (DAY, 10, "x"))
    assert sorted((r.s, r.e) for r in clipped(a, DAY, 2 * DAY).collect()) == [(DAY, DAY + 100), (2 * DAY - 30, 2 * DAY)]


def test_work_time_past_midnight_and_overlapping_segments(spark):
    a = acts(spark, (23 * HOUR, 2 * HOUR, "x"), (DAY + HOUR, HOUR, "x"))
    got = as_map(act.work_time(a, [(22 * HOUR, HOUR), (22 * HOUR + 600, 23 * HOUR)]), "day", "work_seconds")
    assert got == {0: HOUR, 1: HOUR}


def test_sessions_start_after_the_gap(spark):
    a = acts(spark, (1000, 100, "x"), (2000, 100, "x"), (3001, 100, "y"))
    got = [(r.session, r.start_ts, r.n) for r in act.session_table(a).orderBy("session").collect()]
    assert got == [(1, 900, 2), (2, 2901, 1)]


def test_timeline_shows_the_newest_and_sums_the_group(spark):
    a = acts(spark, (1000, 100, "x"), (2000, 200, "x"), (1500, 50, "y"))
    got = {r.app: (r.id, r.seconds) for r in act.timeline(a, 0, DAY).collect()}
    assert got == {"x": (1, 300), "y": (2, 50)}


def test_empty_table(spark):
    a = acts(spark, (1, 1, "x")).where("false")
    for f in (act.hourly_covered, act.session_table, act.day_totals, act.hour_app_attribution, act.active_runs, act.merged_captures):
        assert f(a).count() == 0
    assert act.hour_of_day(a).count() == 24
