"""Rounds of an index: killed, repeated, in competition, and vectors of old contents."""

import random

import pytest
from pyspark.sql import functions as F

from sparkact.catalog import Catalog
from sparkact.operators.reports import memory_chunks
from sparkact.operators.rounds import CHUNK, SENTINEL, Rounds

SCHEMA = "id long, end_ts long, app string, url string, title string, content string"


def records(spark, n=120):
    r = random.Random(4)
    rows = [(3 * i, 86400 * r.randint(0, 1), r.choice("ab"), r.choice([None, "http://x.org/1"]), r.choice(["t", "u"]), r.choice(["", None, "word " * r.randint(1, 9)])) for i in range(n)]
    rows += [(1000, 0, "empty", None, "t", None), (1001, 0, "empty", None, "t", "")]
    return spark.createDataFrame(rows, SCHEMA)


def step(rounds, d, limit=50):
    return rounds.round(d, F.col("title"), F.col("content"), limit)


def shown(table):
    return {(r.kind, r.date, r.app, r.place, r.content, r.content_hash, tuple(r.vector or ()), r.last_id) for r in table.collect()}


def test_rounds_end_in_the_same_index(spark, tmp_path):
    d = records(spark)
    a, b = Rounds(spark, f"file://{tmp_path}/a"), Rounds(spark, f"file://{tmp_path}/b")
    while step(a, d, 50):
        pass
    while step(b, d, 500):
        pass
    assert a.version() == 3 and b.version() == 1 and shown(a.table()) == shown(b.table())
    whole = memory_chunks(d, F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    assert {(r.date, r.app, r.place, len(r.content), r.last_id) for r in a.table().collect()} == {(r.date, r.app, r.place, len(r.content), r.last_id) for r in whole.collect()}
    assert [(r.kind, r.last_id) for r in a.table().where("app = 'empty'").collect()] == [(SENTINEL, 1001)]
    assert not step(a, d) and a.version() == 3


def test_a_killed_round_is_repeated(spark, tmp_path, monkeypatch):
    d = records(spark)
    a, b = Rounds(spark, f"file://{tmp_path}/a"), Rounds(spark, f"file://{tmp_path}/b")
    step(a, d)
    before = shown(a.table())
    with monkeypatch.context() as m:  # dies when its rows are written, before they are published
        m.setattr(Catalog, "publish", lambda self, df, version, check=None: (df.write.parquet(f"{self.path}/v{version}-dead"), 1 / 0))
        with pytest.raises(ZeroDivisionError):
            step(a, d)
    assert a.version() == 1 and shown(a.table()) == before
    while step(a, d):
        pass
    while step(b, d):
        pass
    assert shown(a.table()) == shown(b.table())


def test_of_two_rounds_one_is_published(spark, tmp_path):
    d = records(spark)
    a, b = Rounds(spark, f"file://{tmp_path}/t"), Rounds(spark, f"file://{tmp_path}/t")
    old = b.version

    def late():
        b.version = old
        step(a, d)
        return 0

    b.version = late  # reads the version, then the other is quicker
    with pytest.raises(RuntimeError):
        step(b, d)
    assert a.version() == 1


def test_vectors_of_contents_that_are_still_there(spark, tmp_path):
    a = Rounds(spark, f"file://{tmp_path}/t")
    d = spark.createDataFrame([(1, 0, "a", None, "t", "one"), (2, 0, "b", None, "t", "two"), (3, 0, "c", None, "t", None), (4, 0, "a", None, "t", "longer"), (5, 0, "b", None, "t", "x")], SCHEMA)
    step(a, d, 3)
    asked = a.queue().withColumn("vector", F.array(F.length("content").cast("float")))
    made = spark.createDataFrame(asked.collect(), asked.schema)
    assert [r.app for r in made.collect()] == ["a", "b"]
    step(a, d, 3)  # a's content changes, b's stays
    a.write_vectors(made.unionByName(made))
    assert {(r.app, r.content, tuple(r.vector or ())) for r in a.table().where(F.col("kind") == CHUNK).collect()} == {("a", "longer", ()), ("b", "two", (3.0,))}
    assert [r.app for r in a.queue().collect()] == ["a"]
    before, version = shown(a.table()), a.version()
    a.compact()
    assert shown(a.table()) == before and a.state(a.version()) == (5, version + 1)
    assert a.catalog.retain(1) == list(range(1, version + 1)) and shown(a.table()) == before
    assert not step(a, d)
