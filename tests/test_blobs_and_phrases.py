"""Vectors as bytes, phrases of time, budgets."""

import datetime
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkact.functions import blobs, phrases
from sparkact.operators import budgets

NAN = float("nan")
LISTS = [[1.0, -2.5, 3e-40], [], None, [NAN, float("inf")], [0.1] * 300, [None, 1.0], [7.0]]


@pytest.mark.parametrize("part", [slice(0, 7), slice(1, 6), slice(3, 3), slice(2, 3), slice(4, 7)])
def test_codec_of_slices(part):
    x = pa.array(LISTS, pa.list_(pa.float32()))[part]
    want = [None if v is None or None in v else struct.pack(f"<{len(v)}f", *v) for v in LISTS[part]]
    assert blobs.to_bytes(x).to_pylist() == want
    tails = [None if w is None else w + b"xyz"[: i % 4] for i, w in enumerate(want)]
    got = blobs.to_floats(pa.array([b"before", *tails], pa.binary())[1:])
    assert [np.float32(g).tobytes() for g in got.to_pylist()] == [w or b"" for w in want]


def test_codec_in_spark(spark):
    rows = [(i, v) for i, v in enumerate(LISTS)] * 3
    d = spark.createDataFrame(rows, "i long, v array<float>").withColumn("b", blobs.encoded(F.col("v")))
    got = d.select("i", "v", "b", blobs.decoded(F.col("b")).alias("again"), blobs.decoded_exactly(F.col("b"), 3).alias("three"), blobs.decoded_exactly(F.concat("b", F.lit(b"a")), 3).alias("tail"), blobs.decoded_exactly(F.col("b"), 2).alias("two")).collect()
    assert len(got) == 3 * len(LISTS)
    for r in got:
        if r.v is None or None in r.v:
            assert r.b is None and r.again is None and r.three is None
        else:
            assert np.float32(r.again).tobytes() == np.float32(r.v).tobytes() and r.tail is None
            assert (r.three is not None) == (len(r.v) == 3) and r.two is None  # NaN is no number
    assert d.limit(0).select(blobs.decoded(F.col("b"))).count() == 0


D = datetime.date
TODAY = D(2024, 3, 31)  # a Sunday, clocks change in Berlin
RANGES = {
    "今天": (TODAY, TODAY), "今日报告": (TODAY, TODAY), "昨天": (D(2024, 3, 30),) * 2, "昨日": (D(2024, 3, 30),) * 2, "前天": (D(2024, 3, 29),) * 2, "最近3天": (D(2024, 3, 28), TODAY), "近 10 天": (D(2024, 3, 21), TODAY),
    "过去1天和最近20天": (D(2024, 3, 11), TODAY), "最近": (D(2024, 3, 24), TODAY), "最近两天": (D(2024, 3, 24), TODAY), "本周": (D(2024, 3, 25), TODAY), "这周": (D(2024, 3, 25), TODAY), "上周": (D(2024, 3, 18), D(2024, 3, 24)),
    "上一周": (D(2024, 3, 18), D(2024, 3, 24)), "本月": (D(2024, 3, 1), TODAY), "这个月": (D(2024, 3, 1), TODAY), "上月": (D(2024, 2, 1), D(2024, 2, 29)), "上个月": (D(2024, 2, 1), D(2024, 2, 29)),
    "上个月到前天": (D(2024, 2, 1), D(2024, 3, 29)), "nothing": (None, None), None: (None, None), "": (None, None), "最近999999999999天": (None, None),
}
SINGLES = {"today": "2024-03-31", None: "2024-03-31", "Yesterday": "2024-03-30", "今日": "2024-03-31", "昨天": "2024-03-30", "前天": "2024-03-29", "本周": "2024-03-25", "上周": "2024-03-18", "2020-02-02": "2020-02-02", "X": "x"}


def test_phrases(spark):
    d = spark.createDataFrame([(q, TODAY) for q in RANGES], "q string, t date")
    assert {r.q: (r.x.start, r.x.end) for r in d.select("q", phrases.range_of(F.col("q"), F.col("t")).alias("x")).collect()} == RANGES
    d = spark.createDataFrame([(q, TODAY) for q in SINGLES], "q string, t date")
    assert {r.q: r.x for r in d.select("q", phrases.single_day(F.col("q"), F.col("t")).alias("x")).collect()} == SINGLES


def test_days_of_a_zone(spark):
    d = spark.sql("SELECT timestamp'2024-03-30 22:59:59' AS a, timestamp'2024-03-30 23:00:00' AS b, timestamp'2024-03-31 21:59:59' AS c, timestamp'2024-03-31 22:00:00' AS d")
    assert [str(x) for x in d.select(*[phrases.local_day(F.col(c), "Europe/Berlin") for c in "abcd"]).first()] == ["2024-03-30", "2024-03-31", "2024-03-31", "2024-04-01"]


def test_budgets_equal_loops(spark):
    r = random.Random(9)
    rows = [(r.choice([1, 1, 1, 2, None]), i, r.choice([0, 1, 5, 30, None])) for i in range(800)]
    d = spark.createDataFrame(rows, "k long, i long, n long").repartition(5)
    want, used = set(), {}
    for k, i, n in rows:
        used[k] = used.get(k, 0) + (n or 0)
        if used[k] <= 700:
            want.add((k, i, used[k]))
    assert {(x.k, x.i, x.used) for x in budgets.within(d, ["k"], ["i"], "n", 700).collect()} == want
    left, total = set(), 0
    for _, i, n in reversed(rows):
        if i >= 100:
            total += n or 0
            if total <= 900:
                left.add(i)
    assert {x.i for x in budgets.retained(d, [-F.col("i")], "n", 900, F.col("i") >= 100).collect()} == left
