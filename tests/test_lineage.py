"""Snapshots: equal sets, one changed member, what is read, and edges."""

import random
import re

from pyspark.sql import functions as F

from sparkact.operators import lineage

SCHEMA = "k long, part string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(n=2000):
    return [(i, "ab"[i % 2], f"text {i}") for i in range(n)] + [(None, "a", None), (None, "a", ""), (5, "b", "text 5"), (5, "b", "text 5")]


def test_order_and_tasks_do_not_matter(spark):
    rows = rows_of()
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    a, b = lineage.saved(frame(spark, rows).repartition(3), ["k", "part"], buckets=64), lineage.saved(frame(spark, mixed).repartition(7), ["k", "part"], buckets=64)
    assert a.root() == b.root() and a.differing(b) == [] and a.changes(b).count() == 0


def test_repeated_members_count(spark):
    a, b = (lineage.saved(frame(spark, [(1, "a", "x")] * n), ["k"], buckets=8) for n in (1, 3))
    assert a.root() != b.root() and [tuple(r) for r in a.changes(b).collect()] == [(1, "changed")]


def test_one_changed_member_reads_one_bucket(spark):
    rows = rows_of()
    a = lineage.saved(frame(spark, rows), ["k", "part"], buckets=64)
    b = lineage.saved(frame(spark, [(k, p, t + "!" if k == 77 else t) for k, p, t in rows]), ["k", "part"], buckets=64)
    found = a.differing(b)
    assert len(found) == 1 and [tuple(r) for r in a.changes(b).collect()] == [(77, "b", "changed")]
    files = {r[0] for r in b.members(found).select(F.input_file_name()).distinct().collect()}
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in files} == set(found)
    assert "PartitionFilters: [isnotnull(bucket" in a.changes(b)._jdf.queryExecution().executedPlan().toString()


def test_changes_equal_loops(spark):
    r = random.Random(2)
    old = {(i, "a"): str(r.randint(0, 5)) for i in range(500)} | {(None, "x"): None}
    new = {k: (v if r.random() < 0.9 else "new") for k, v in old.items() if r.random() < 0.9} | {(i, "b"): "added" for i in range(20)} | {(None, "y"): ""}
    a, b = (lineage.saved(frame(spark, [(*k, v) for k, v in x.items()]), ["k", "part"], buckets=16) for x in (old, new))
    want = {(*k, "removed") for k in old.keys() - new.keys()} | {(*k, "added") for k in new.keys() - old.keys()} | {(*k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]}
    assert {tuple(x) for x in a.changes(b).collect()} == want
    first = lineage.edges(a, "s1")
    second = {tuple(x) for x in lineage.edges(b, "s2", a, first).collect()}
    assert second == {(*k, "s1" if k in old and old[k] == v else "s2") for k, v in new.items()}


def test_empty(spark):
    a, b = lineage.saved(frame(spark, []), ["k"], buckets=8), lineage.saved(frame(spark, [(1, "a", "x")]), ["k"], buckets=8)
    assert a.root() == lineage.EMPTY and [tuple(r) for r in a.changes(b).collect()] == [(1, "added")] and [tuple(r) for r in b.changes(a).collect()] == [(1, "removed")]
