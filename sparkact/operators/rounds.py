"""An index of chunks that is built in rounds, each of which can be killed and repeated.

A round takes the next records by id, makes chunks of them and publishes, as one version of a
``Catalog``, the chunks that it adds or changes together with its cursor. The table is the latest row of each key
over all versions since the last compaction, so a round writes what it touches and nothing else. Two rounds
that begin at one version can't both be published; one that dies before leaves no trace in the table.
Groups of records without content leave a sentinel, so that nobody looks at them again.

Vectors are written for (key, hash of the content): one that was made for a content that has changed meanwhile is not taken.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkact.catalog import Catalog
from sparkact.operators.reports import memory_chunks

KEYS = ["date", "app", "place"]
ROWS = "kind string, date long, app string, place string, titles string, content string, content_hash string, vector array<float>, last_id long"
CHUNK, SENTINEL, CURSOR = "chunk", "sentinel", "cursor"


def same_keys(a: DataFrame, b: DataFrame, prefix: str) -> Column:
    return reduce(and_, [a[k].eqNullSafe(b[f"{prefix}{k}"]) for k in KEYS])


class Rounds:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.catalog = spark, Catalog(spark, path)

    def version(self) -> int:
        return self.catalog.current()

    def state(self, version: int) -> tuple[int, int]:
        """(last id, the version at which the table begins) as of ``version``."""
        if not version:
            return -(1 << 63), 1
        row = self.catalog.read(version).where(F.col("kind") == CURSOR).first()
        return row["last_id"], row["date"]

    def table(self, version: int | None = None) -> DataFrame:
        """The latest chunk or sentinel of each key."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], ROWS)
        parts = [self.catalog.read(v).withColumn("_v", F.lit(v)) for v in range(self.state(version)[1], version + 1)]
        rows = reduce(DataFrame.unionByName, parts).where(F.col("kind") != CURSOR)
        others = [c for c in rows.columns if c not in (*KEYS, "_v")]
        return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*others), "_v").alias("r")).select("r.kind", *KEYS, *[f"r.{c}" for c in others if c != "kind"])

    def publish(self, rows: DataFrame, version: int, last_id: int, base: int) -> int:
        """``rows`` and the cursor as the version behind ``version``; RuntimeError if another was quicker."""
        if self.version() != version:
            raise RuntimeError(f"version {version + 1} was published meanwhile")
        cursor = self.spark.createDataFrame([(CURSOR, base, None, None, None, None, None, None, last_id)], ROWS)
        return self.catalog.publish(rows.select(*[x.split()[0] for x in ROWS.split(", ")]).unionByName(cursor), version + 1)

    def round(self, records: DataFrame, title: Column, content: Column, limit: int = 1500) -> bool:
        """One round over the next ``limit`` records (id, end_ts, app, url, and what ``title`` and ``content`` use); false
        if there are none. Of two contents of a key the longer stays, the one there is of equally long ones."""
        version = self.version()
        last_id, base = self.state(version)
        batch = records.where(F.col("id") > last_id).orderBy("id").limit(limit)
        until = batch.agg(F.max("id")).first()[0]
        if until is None:
            return False
        batch = records.where((F.col("id") > last_id) & (F.col("id") <= until))  # the same rows, without a single task
        new = memory_chunks(batch, F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
        old = self.table(version).withColumnsRenamed({c: f"old_{c}" for c in [x.split()[0] for x in ROWS.split(", ")]})
        both = new.join(old, same_keys(new, old, "old_"), "left")
        longer = F.coalesce(F.length("content") > F.length("old_content"), F.lit(True))
        text = F.when(longer, F.col("content")).otherwise(F.col("old_content"))
        rows = both.select(
            F.when(text == "", SENTINEL).otherwise(CHUNK).alias("kind"), *KEYS, F.when(longer, F.col("titles")).otherwise(F.col("old_titles")).alias("titles"), text.alias("content"),
            F.sha2(text, 256).alias("content_hash"), F.when(~longer | (text == F.col("old_content")), F.col("old_vector")).alias("vector"), F.greatest("last_id", "old_last_id").alias("last_id"),
        )
        self.publish(rows, version, until, base)
        return True

    def queue(self, limit: int = 32) -> DataFrame:
        """The first chunks by key that have no vector."""
        return self.table().where((F.col("kind") == CHUNK) & F.col("vector").isNull()).orderBy(*KEYS).limit(limit).select(*KEYS, "content", "content_hash")

    def write_vectors(self, vectors: DataFrame) -> None:
        """Take vectors (keys, content_hash, vector) of contents that are still there. Of several for one content the smallest is taken."""
        version = self.version()
        last_id, base = self.state(version)
        one = vectors.where("vector is not null").groupBy(*[F.col(k).alias(f"new_{k}") for k in KEYS], F.col("content_hash").alias("new_hash")).agg(F.min("vector").alias("new_vector"))
        table = self.table(version).where(F.col("kind") == CHUNK)
        hit = table.join(one, same_keys(table, one, "new_") & (table["content_hash"] == one["new_hash"]))
        self.publish(hit.withColumn("vector", F.col("new_vector").cast("array<float>")), version, last_id, base)

    def compact(self) -> None:
        """Publish the whole table as a version at which it begins; earlier ones may then be retired."""
        version = self.version()
        self.publish(self.table(version), version, self.state(version)[0], version + 1)
