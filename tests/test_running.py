"""Running aggregates against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sparkact.operators.running import running


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("partitions", [2, 7])
def test_equals_loop(spark, keys, partitions):
    r = random.Random(partitions)
    rows = [(r.choice([1, 1, 1, None, 2, 7]), r.choice([None, r.randint(0, 50)]), i, r.choice([None, r.randint(0, 1000)])) for i in range(3000)]
    d = spark.createDataFrame(rows, "k long, o long, i long, v long").withColumns({"__k0": F.lit(1), "a.b": F.lit("x")}).repartition(3)
    found = running(d, keys, ["o", "i"], {"s": ("sum", "v"), "c": ("count", F.lit(1)), "x": ("xor", "v"), "m": ("max", "v")}, partitions)
    assert found.columns == [*d.columns, "s", "c", "x", "m"]
    got = {r.i: (r.s, r.c, r.x, r.m) for r in found.collect()}
    seen = {}
    for k, _, i, v in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        s, c, x, m = seen.get(k if keys else 0, (None, 0, None, None))
        if v is not None:
            s, x, m = (s or 0) + v, (x or 0) ^ v, max(m or 0, v)
        seen[k if keys else 0] = s, c + 1, x, m
        assert got[i] == (s, c + 1, x, m)


def test_empty(spark):
    assert running(spark.createDataFrame([], "k long, v long"), ["k"], ["v"], {"s": ("sum", "v")}).count() == 0


def test_only_totals_meet_in_one_task(spark):
    d = spark.range(100).select("id", (F.col("id") % 3).alias("v"))
    plan = running(d, [], ["id"], {"s": ("sum", "v")})._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [plan[i + 1] for i, line in enumerate(plan) if "SinglePartition" in line]
    assert all("HashAggregate" in line for line in below)  # at most one row a partition
