"""Null keys, ties, one exchange, overlapping records: what earlier versions got wrong."""

import json
import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkact.catalog import Catalog
from sparkact.functions import privacy
from sparkact.functions.intervals import attributed
from sparkact.operators import activity, messages, records, reports
from sparkact.sources.archive import timeline_documents, trace_lines


def test_attribution_equals_every_second(spark):
    r = random.Random(3)
    rows = []
    for i in range(150):
        s, n = r.randint(0, 300), r.choice([0, 1, 5, 40, 120])
        rows.append((r.choice(["a", "b", None]), s, min(s + n, 400), s + n, i, r.choice("xyz")))
    rows += rows[:5]
    want = {}
    for owner in ("a", "b", None):
        for t in range(400):
            open_ = [x for x in rows if x[0] == owner and x[1] <= t < x[2]]
            if open_:
                app = max(open_, key=lambda x: (x[3], x[4], x[5]))[5]
                want[owner, app] = want.get((owner, app), 0) + 1
    d = spark.createDataFrame(rows, "owner string, s long, e long, end_ts long, id long, app string")
    assert {(x.owner, x.app): x.seconds for x in attributed(d, ["owner"], ["app"]).collect()} == want


def test_attribution_of_fifty_thousand_open_records(spark):
    """All records of one hour overlap: pairs would be 1.25 thousand million."""
    d = spark.range(50_000).select(F.lit(1).alias("owner"), (F.col("id") / 20).cast("long").alias("s"), F.lit(3600).cast("long").alias("e"), (3600 + F.col("id")).alias("end_ts"), "id", (F.col("id") % 3).alias("app"))
    began = time.perf_counter()
    assert sum(r.seconds for r in attributed(d, ["owner"], ["app"]).collect()) == 3600
    assert time.perf_counter() - began < 60


def acts(spark):
    rows = [(1, 1, "a", "http://x.org/", 10, 20, 10, 1), (2, 1, "a", "http://x.org", 20, 30, 10, 3), (3, 1, "a", None, 30, 40, 10, 1), (4, None, None, None, 30, 45, 15, None)]
    return spark.createDataFrame(rows, "id long, owner long, app string, url string, start_ts long, end_ts long, duration long, k long")


def test_timeline_has_one_exchange(spark):
    found = activity.timeline(acts(spark), 0, 100)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in found.collect()} == {(2, 30, 1, "a", "http://x.org", 20), (3, 40, 1, "a", "", 10), (4, 45, None, None, "", 15)}


def test_browser_column(spark):
    by = lambda c: {tuple(r) for r in reports.by_browser(acts(spark), c).collect()}
    assert by("app") == {("x.org", "a", 20)}
    assert by(F.when(F.col("k") == 3, F.col("app"))) == {("x.org", "a", 10), ("x.org", "other", 10)}


def test_documents_of_owners(spark):
    t = activity.timeline(acts(spark), 0, 100).withColumn("day", F.lit(0))
    got = {r.owner: json.loads(r.document) for r in timeline_documents(t).collect()}
    assert [x["id"] for x in got[1]["records"]] == [2, 3] and got[1]["n"] == 2 and got[None]["n"] == 1


def test_trace_lines(spark, tmp_path):
    for name, cut in (("a", ""), ("b", '{"eventId": "9'), ("c", "")):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"eventId": "{name}{i}"}}\n' for i in range(500)) + cut)
    got = trace_lines(spark, str(tmp_path), "eventId string")
    assert sorted(r.eventId for r in got.collect()) == sorted(f"{n}{i}" for n in "abc" for i in range(500))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "d.jsonl").write_text('{"eventId": "1"}\nbroken\n{"eventId": "2"}\n')
    with pytest.raises(PySparkException):
        trace_lines(spark, str(tmp_path), "eventId string").collect()


def test_upsert_of_null_keys_and_retention(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    frame = lambda *rows: spark.createDataFrame(rows, "a long, b string, v long")
    c.upsert(frame((1, "x", 1), (None, "x", 2), (None, None, 3)), ["a", "b"], 1)
    c.upsert(frame((None, "x", 20), (None, None, 30), (2, None, 4)), ["a", "b"], 2)
    assert {tuple(r) for r in c.read().collect()} == {(1, "x", 1), (None, "x", 20), (None, None, 30), (2, None, 4)}
    c.upsert(frame((1, "x", 5)), ["a", "b"], 3)
    assert c.retain(2) == [1] and c.read(2).count() == 4 and c.read().where("a = 1").first().v == 5
    with pytest.raises(LookupError):
        c.read(1)
    assert c.retain(2) == []


def test_equal_versions_have_a_defined_winner(spark):
    rows = [(1, 5, "a"), (1, 5, "c"), (1, 5, "b")]
    frame = lambda r: spark.createDataFrame(r, "k long, v long, x string")
    for part in (rows, rows[::-1]):
        assert [tuple(r) for r in messages.latest_wins(frame(rows[:0]), frame(part).repartition(3), ["k"], "v").collect()] == [(1, 5, "c")]


def test_names_are_ignored_as_displayed(spark):
    d = spark.createDataFrame([("msedge.exe",), ("Code",), ("other",)], "app string")
    assert {r.app for r in d.where(privacy.ignored(F.col("app"), ["Microsoft Edge", "vs code"])).collect()} == {"msedge.exe", "Code"}


def test_glued_addresses_are_no_hint(spark):
    d = spark.createDataFrame([("linux.iopagetitle - Browser",), ("docs.example.com - Browser",)], "t string")
    assert [r.h for r in d.select(records.page_hint(F.col("t")).alias("h")).collect()] == [None, "https://docs.example.com"]
