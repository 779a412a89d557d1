"""Snapshots of a set of members with a tree of digests, so that two are compared without reading both.

Members are dealt to buckets by their key, and each bucket to a folder. A bucket's digest is its number of
members and two sums of 64-bit hashes of their digests, so that neither order nor tasks matter and
repeated members count; nodes above are SHA-256 of their children. Equal roots are equal
sets; else only the folders of buckets whose leaves differ are read.

Lineage: an edge says which source a member's current content came from. A new snapshot takes over its parent's edges
but for the members that it adds or changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkact.functions.text import prefixed_digest
from sparkact.sources.shared import new_path

FAN_OUT = 32
EMPTY = ""


def content_digest(columns: list[str]) -> Column:
    """SHA-256 of the columns, each behind its length; nulls differ from empty strings."""
    return prefixed_digest(*[x for c in columns for x in (F.when(F.col(f"`{c}`").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))])


@dataclass
class Snapshot:
    """A saved set: ``members`` (the columns, member_digest; folders by bucket), ``leaves`` (bucket, n, digest), ``root``."""

    spark: SparkSession
    path: str
    keys: list[str]
    buckets: int
    schema: T.StructType

    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/leaves")

    def root(self) -> str:
        return self.spark.read.text(f"{self.path}/root").first()[0]

    def members(self, buckets: list[int] | None = None) -> DataFrame:
        """All members, or those of some buckets, whose folders alone are read."""
        table = self.spark.read.schema(self.schema).parquet(f"{self.path}/members")
        return table.where(F.col("bucket").isin(buckets)) if buckets is not None else table

    def differing(self, other: Snapshot) -> list[int]:
        """The buckets whose leaves differ; none if the roots are equal. At most ``buckets`` numbers."""
        if self.buckets != other.buckets or self.keys != other.keys:
            raise ValueError("snapshots of other keys or buckets")
        if self.root() == other.root():
            return []
        a, b = (x.leaves().select("bucket", F.col("digest").alias(n)) for x, n in ((self, "a"), (other, "b")))
        return sorted(r[0] for r in a.join(b, "bucket", "full_outer").where("not (a <=> b)").select("bucket").collect())

    def changes(self, newer: Snapshot) -> DataFrame:
        """(keys, change): ``added``, ``removed`` or ``changed`` from this snapshot to a newer one. A key with several members has changed
        if any of them differs."""
        found = self.differing(newer)

        def side(x: Snapshot, name: str) -> DataFrame:
            return x.members(found).groupBy(*[F.col(f"`{k}`").alias(k) for k in self.keys]).agg(F.array_sort(F.collect_list("member_digest")).alias(name))

        a, b = side(self, "_a"), side(newer, "_b").withColumnsRenamed({k: f"_{k}" for k in self.keys})
        both = a.join(b, reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_{k}`")) for k in self.keys]), "full_outer").where("not (_a <=> _b)")
        what = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
        return both.select(*[F.when(F.col("_a").isNull(), F.col(f"`_{k}`")).otherwise(F.col(f"`{k}`")).alias(k) for k in self.keys], what.alias("change"))


def saved(members: DataFrame, keys: list[str], path: str | None = None, buckets: int = 1024) -> Snapshot:
    """Save ``members`` in a folder (a new one in the shared folder by default)."""
    spark = members.sparkSession
    path = path or new_path(spark, "snapshot")
    others = [c for c in members.columns if c not in keys]
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")
    rows = members.withColumns({"bucket": bucket, "member_digest": content_digest([*keys, *others])})
    # the key spreads a bucket over tasks only as far as a file of each allows; a hot key's members stay in several tasks
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(parts, "bucket", "member_digest").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/members")
    table = Snapshot(spark, path, keys, buckets, rows.schema)
    lane = lambda i: F.sum(F.xxhash64(F.lit(i), "member_digest").cast("decimal(20,0)"))
    leaves = table.members().groupBy("bucket").agg(F.count("*").alias("n"), lane(1).alias("a"), lane(2).alias("b"))
    leaves.select("bucket", "n", F.sha2(F.concat_ws(":", "n", F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest")).coalesce(1).write.parquet(f"{path}/leaves")
    level = table.leaves().select(F.col("bucket").cast("long").alias("node"), "digest")
    width = buckets
    while width > 1:  # log(buckets) / log(FAN_OUT) steps over at most ``buckets`` rows
        child = F.concat_ws(":", F.col("node").cast("string"), "digest")
        level = level.groupBy(F.floor(F.col("node") / FAN_OUT).alias("up")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(child)), ","), 256).alias("digest")).select(F.col("up").alias("node"), "digest")
        width = -(-width // FAN_OUT)
    level.agg(F.coalesce(F.max("digest"), F.lit(EMPTY)).alias("value")).coalesce(1).write.text(f"{path}/root")
    return table


def edges(newer: Snapshot, source: str, parent: Snapshot | None = None, parent_edges: DataFrame | None = None) -> DataFrame:
    """(keys, source): which source each member of ``newer`` has its content from."""
    keys = [F.col(f"`{k}`") for k in newer.keys]
    every = newer.members().select(*keys).distinct()
    if parent is None or parent_edges is None:
        return every.withColumn("source", F.lit(source))
    changed = parent.changes(newer).select(*newer.keys).withColumnsRenamed({k: f"_{k}" for k in newer.keys})
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_{k}`")) for k in newer.keys])
    kept = parent_edges.join(changed, same, "left_anti")
    fresh = every.join(changed, same, "left_semi").withColumn("source", F.lit(source))
    return kept.select(*newer.keys, "source").unionByName(fresh)
