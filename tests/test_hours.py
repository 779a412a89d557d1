"""Hour summaries of a stream: empty hours, late records, a restart, and equality with a batch."""

import random

import pytest

from sparkact.catalog import Catalog
from sparkact.streaming import hours
from sparkact.streaming.windows import upserted

BASE = 1000  # the first hour: watermarks don't go below the epoch
SCHEMA = "owner long, end_ts long, duration long, app string"


@pytest.fixture(autouse=True)
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", hours.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


class Run:
    def __init__(self, spark, root, **options):
        self.spark, self.root, self.options, self.n = spark, root, options, 0
        (root / "in").mkdir()

    def start(self):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(self.root / "in"))
        found = hours.summaries(stream, **self.options)
        write = upserted(str(self.root / "out"), ["owner", "hour"], ["revision"])
        rows = self.rows = []

        def both(batch, number):
            batch.persist()
            rows.extend((r[0], r[1] - BASE, *r[2:]) for r in batch.collect())
            write(batch, number)
            batch.unpersist()

        return found.writeStream.outputMode("update").foreachBatch(both).option("checkpointLocation", str(self.root / "c")).start()

    def feed(self, *batches):
        """Each batch in a file of its own, one stream run for all; returns the rows written."""
        for rows in batches:
            self.spark.createDataFrame([(o, t + BASE * 3600, d, a) for o, t, d, a in rows], SCHEMA).coalesce(1).write.json(str(self.root / f"b{self.n}"))
            for part in (self.root / f"b{self.n}").glob("part-*"):
                part.rename(self.root / "in" / f"{self.n:03d}.json")
            self.n += 1
        q = self.start()
        q.processAllAvailable()
        q.stop()
        return self.rows

    def table(self):
        return {(r[0], r[1] - BASE, *r[2:]) for r in Catalog(self.spark, str(self.root / "out")).read().collect()}


def test_late_record_and_restart(spark, tmp_path):
    run = Run(spark, tmp_path, late=4 * 3600, grace=600)
    first = run.feed([(1, 100, 10, "x"), (1, 200, 30, "y"), (2, 50, 5, None)], [(1, 3 * 3600 + 5, 7, "x")], [(1, 3 * 3600 + 700, 1, "x")])
    assert (1, 0, 2, 40, "y, x", "provisional", 1) in first and (1, 0, 2, 40, "y, x", "final", 2) in first
    assert not [r for r in first if r[1] == 3 and r[5] == "final"]
    # another run of the query, from the checkpoint: hours 1 and 2 of owner 1 were empty, a late record comes for hour 0
    second = run.feed([(1, 300, 100, "x"), (1, 4 * 3600 + 700, 2, "z")])
    assert (1, 0, 3, 140, "x, y", "corrected", 3) in second
    run.feed([(3, 6 * 3600, 1, "w")])
    assert {(r[0], r[1], r[2], r[3], r[4]) for r in run.table() if r[0] == 1} == {(1, 0, 3, 140, "x, y"), (1, 1, 0, 0, ""), (1, 2, 0, 0, ""), (1, 3, 2, 8, "x"), (1, 4, 1, 2, "z")}
    assert {r[5] for r in run.table() if r[0] == 1 and r[1] in (1, 2, 3)} == {"final"}


def test_equals_batch(spark, tmp_path):
    """Random records, out of order by less than what is waited for, over several runs of the query."""
    r = random.Random(8)
    rows = sorted(((r.choice([1, 2, 3]), r.randint(0, 40 * 3600), r.randint(0, 500), r.choice(["a", "b", None, "c"])) for _ in range(400)), key=lambda x: x[1] + r.randint(0, 4 * 3600))
    rows += [(o, 60 * 3600, 1, "end") for o in (1, 2, 3)]
    run = Run(spark, tmp_path, late=6 * 3600, grace=600)
    for at in range(0, len(rows), 150):
        run.feed(*[rows[i : i + 50] for i in range(at, min(at + 150, len(rows)), 50)])
    run.feed([(9, 80 * 3600, 1, "x")])
    want = {tuple(x) for x in hours.summarised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {x[:5] for x in run.table() if x[0] != 9} == want
    assert {x[5] for x in run.table() if x[0] != 9} <= {"final", "corrected"}
