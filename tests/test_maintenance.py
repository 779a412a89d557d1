"""Statistics after changes against statistics made anew."""

import random

from sparkact.operators import maintenance as m

SCHEMA = "owner long, id long, app string, category string, start_ts long, end_ts long, duration long"


def record(r, i):
    end = r.randint(0, 3 * 86400)
    n = r.choice([0, 5, 600, 9000])
    return (r.choice([1, 2, None]), i, r.choice(["a", "b", None]), r.choice("xy"), end - n, end, r.choice([n, None]))


def test_equals_recomputation(spark):
    r = random.Random(5)
    rows = {i: record(r, i) for i in range(300)}
    frame = lambda x: spark.createDataFrame(list(x), SCHEMA)
    sums, hours = m.usage(m.changes(frame(rows.values()))), m.covered_hours(frame(rows.values()))
    docs = m.documents(sums)
    for _ in range(2):
        gone = [rows.pop(i) for i in r.sample(sorted(rows), 40)]
        came = {i: record(r, i) for i in range(1000 + 100 * len(rows), 1000 + 100 * len(rows) + 20)}
        moved = {i: (*rows[i][:3], "own", *rows[i][4:]) for i in r.sample(sorted(rows), 20)}
        signed = m.changes(frame(came.values()), frame(gone)).unionByName(m.reclassified(frame(rows[i] for i in moved), frame(moved.values())))
        rows |= came | moved
        hours = m.updated_covered(hours, frame(rows.values()), signed)
        sums = m.updated_usage(sums, signed)
        docs = m.updated_documents(docs, sums, signed)
    now = frame(rows.values())
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    assert same(sums, m.usage(m.changes(now)))
    assert same(hours, m.covered_hours(now))
    assert same(docs, m.documents(m.usage(m.changes(now))))


def test_nothing_is_left(spark):
    d = spark.createDataFrame([(1, 1, "a", "x", 0, 100, 100)], SCHEMA)
    assert m.updated_usage(m.usage(m.changes(d)), m.changes(deleted=d)).count() == 0
    assert m.updated_covered(m.covered_hours(d), d.limit(0), m.changes(deleted=d)).count() == 0
    assert [r.seconds for r in m.updated_covered(m.covered_hours(d), d, m.changes(d.limit(0))).collect()] == [100]
