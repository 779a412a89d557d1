from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from sparkact.functions import apps, localtime
from sparkact.functions.text import clean_lines
from sparkact.operators import reports
from sparkact.sources.tables import activities


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "America/Sao_Paulo", "Australia/Lord_Howe"])
def test_local_days_where_clocks_change(spark, zone):
    start = int(datetime(2018, 11, 1, tzinfo=UTC).timestamp())
    rows = [(start + 1801 * i,) for i in range(0, 20000, 7)]
    df = spark.createDataFrame(rows, "t long")
    got = df.select("t", localtime.local_date(F.col("t"), zone), localtime.day_start(F.col("t"), zone), localtime.next_hour(F.col("t"), zone)).collect()
    for t, date, midnight, following in got:
        wall = datetime.fromtimestamp(t, ZoneInfo(zone))
        assert date == wall.date().isoformat()
        day = datetime(wall.year, wall.month, wall.day, tzinfo=ZoneInfo(zone))
        first = day.timestamp()
        if datetime.fromtimestamp(first, ZoneInfo(zone)).replace(tzinfo=None) != day.replace(tzinfo=None):  # midnight was skipped
            first = (day.replace(tzinfo=None) - timedelta(hours=0)).replace(tzinfo=ZoneInfo(zone)).timestamp()
        assert midnight == int(first)
        assert 0 < following - t <= 3600 and datetime.fromtimestamp(t, ZoneInfo(zone)).minute * 60 + wall.second + following - t == 3600


def test_repeated_local_time_is_the_earlier(spark):
    at = spark.sql("SELECT timestamp_ntz'2024-11-03 01:30:00' AS a, timestamp_ntz'2024-03-10 02:30:00' AS b")
    early, skipped = at.select(localtime.epoch_of(F.col("a"), "America/New_York"), localtime.epoch_of(F.col("b"), "America/New_York")).first()
    assert early == int(datetime(2024, 11, 3, 5, 30, tzinfo=UTC).timestamp())
    assert skipped == int(datetime(2024, 3, 10, 7, 30, tzinfo=UTC).timestamp())


def test_program_names(spark):
    rows = [("  CHROME.exe ", "Google Chrome"), ("code.EXE", "VS Code"), ("wxwork", "WeCom"), ("My Tool.exe", "My Tool"), ("zoom.us", "Zoom"), ("Code.Exe", "Code.Exe")]
    df = spark.createDataFrame(rows, "app string, name string")
    assert df.where(apps.display_name(F.col("app")) != F.col("name")).count() == 0
    kinds = spark.createDataFrame([("Tencent Lemon",), ("cent",), ("Arch",), ("ARC",), ("360SE.exe",), ("dwm.exe",)], "app string").select("app", apps.is_browser(F.col("app")), apps.is_system(F.col("app"))).collect()
    assert [tuple(k) for k in kinds] == [("Tencent Lemon", False, False), ("cent", True, False), ("Arch", False, False), ("ARC", True, False), ("360SE.exe", True, False), ("dwm.exe", False, True)]


def test_merged_domains(spark):
    rows = [("https://site.iopages", True), ("linux.dolatest", True), ("linux.do", False), ("a.b.iopages", False), ("https://site.iopages/x", False), ("site.dolate1", False), ("site.domain", False), ("site.Domains:80", True)]
    df = spark.createDataFrame(rows, "u string, m boolean")
    assert [r for r in df.where(apps.is_merged_domain(F.col("u")) != F.col("m")).collect()] == []


def test_clean_lines_keeps_the_first_of_repeated_lines(spark):
    text = "Alpha\nbeta\nALPHA\n x\nGamma  1\nbeta\ngamma 1\n"
    assert spark.createDataFrame([(text,), (None,), ("",)], "t string").select(clean_lines(F.col("t"))).collect() == [("Alpha\nbeta\nGamma 1",), (None,), ("",)]


def test_time_bounds_reach_the_scan(spark):
    plan = activities(spark, "/root/testdata/sf0.001", 1704600000, 1704700000)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_nested_documents_without_hidden_apps(spark):
    rows = [(1, 1, "a", "u1", 5, 100), (2, 1, "b", None, 7, 200), (3, 1, "a", "u2", 6, 300), (4, 2, "b", "u", 1, 90000)]
    df = spark.createDataFrame(rows, "id long, owner long, app string, url string, duration long, end_ts long")
    docs = {(r.owner, r.day): r for r in reports.without(reports.daily_documents(df), lambda a: a["app"] == "b", lambda u: u["url"] == "u1").collect()}
    assert docs[1, 0].total == 11 and [u.url for u in docs[1, 0].apps[0].urls] == ["u2"] and docs[2, 1].total == 0 and docs[2, 1].apps == []
