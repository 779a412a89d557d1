import pytest
from pyspark.sql import functions as F

from sparkact.operators import records


def test_cursor_belongs_to_its_filters():
    text = records.cursor([7, 3], {"app": "view"})
    assert records.position_of(text, {"app": "view"}) == [7, 3]
    for filters in ({"app": "click"}, {}):
        with pytest.raises(ValueError):
            records.position_of(text, filters)


def test_pages_cover_all_rows_once(spark):
    rows = spark.createDataFrame([(i // 3, i) for i in range(20)], "end_ts long, id long")
    seen, after = [], None
    while page := records.trace_page(rows, 6, after).collect():
        seen += [r.id for r in page]
        after = records.cursor([page[-1].end_ts, page[-1].id], {})
    assert seen == list(range(20))


def test_repeated_keys_are_refused(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k int, v string")
    assert records.required_unique(rows, ["v"]) is rows
    with pytest.raises(ValueError):
        records.required_unique(rows, ["k"])


def test_urls_without_unseen_characters(spark):
    rows = spark.createDataFrame([("​ example.org﻿",), ("",), (None,), ("a b.org",)], "t string")
    assert [r.u for r in rows.select(records.canonical_url(F.col("t")).alias("u")).collect()] == ["https://example.org", None, None, None]


def test_digest_follows_the_order_of_hits(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "y"), (2, 1, "x"), (3, 1, "y"), (3, 0, "x")], "q int, rank int, key string")
    by = {r.q: r.digest for r in records.result_digest(a, ["q"], ["key"], "rank").collect()}
    assert by[1] == by[3] != by[2]
