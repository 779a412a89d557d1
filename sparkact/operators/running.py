"""Running aggregates of keys of any size, in two levels.

A window over a key puts all rows of the key into one task, a window over nothing puts all rows
there. Here the rows are ranged by key and order, so that a hot key lies in many partitions:
1. each partition's rows are aggregated from the partition's first row of the key on,
2. keys that reach over a partition's end (at most as many as there are partitions) are
   aggregated by partition, and what stands before a partition is added to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkact.sources.shared import written

#: Aggregate, and how two of its results are one.
KINDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "count": (F.count, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, F.greatest),
}


def running(df: DataFrame, keys: list[str], order: list[Column | str], wanted: dict[str, tuple[str, Column | str]], partitions: int | None = None) -> DataFrame:
    """``df`` with a column for each entry of ``wanted``, name: (kind, value): the aggregate over
    the rows of the same key up to this one, ascending in ``order``, nulls first.

    Null keys are one key; a null value adds nothing (a sum without any value is null). Empty
    ``keys`` mean all rows. Rows of equal key and order are taken in any order, so that ``order``
    must be total for defined results.
    """
    n = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key, place = [f"__k{i}" for i in range(len(keys))], [f"__o{i}" for i in range(len(order))]
    kinds = [kind for kind, _ in wanted.values()]
    held = df.select(
        F.struct("*").alias("__row"), *[column(k).alias(a) for k, a in zip(keys, key, strict=True)],
        *[column(o).alias(a) for o, a in zip(order, place, strict=True)], *[column(v).alias(f"__v{i}") for i, (_, v) in enumerate(wanted.values())],
    )
    sort = [F.col(p).asc_nulls_first() for p in place]
    ranged = held.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in key], *sort)
    table = written(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    so_far = W.partitionBy("__part", *key).orderBy(*sort).rowsBetween(W.unboundedPreceding, 0)
    local = table.select("*", *[KINDS[kind][0](f"__v{i}").over(so_far).alias(f"__a{i}") for i, kind in enumerate(kinds)])
    # only a key at a partition's end can lie in another one too
    whole = F.struct(*key) if key else F.lit(0)
    ends = table.groupBy("__part").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    crossing = ends.select("__part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("__cross")).groupBy("__cross").agg(F.count("*").alias("c")).where("c > 1").select("__cross")
    totals = table.withColumn("__key", whole).join(F.broadcast(crossing), F.col("__key").eqNullSafe(F.col("__cross")), "left_semi")
    totals = totals.groupBy("__part", "__key").agg(*[KINDS[kind][0](f"__v{i}").alias(f"__t{i}") for i, kind in enumerate(kinds)])
    before = W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    earlier = [(F.sum if kind == "count" else KINDS[kind][0])(f"__t{i}").over(before).alias(f"__b{i}") for i, kind in enumerate(kinds)]
    offsets = totals.select(F.col("__part").alias("__p"), F.col("__key").alias("__f"), *earlier)
    joined = local.join(F.broadcast(offsets), (F.col("__part") == F.col("__p")) & whole.eqNullSafe(F.col("__f")), "left")

    def both(i: int, kind: str) -> Column:
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        return F.coalesce(KINDS[kind][1](b, a), a, b)

    return joined.select(*[F.col("__row").getField(c).alias(c) for c in df.columns], *[both(i, kind).alias(name) for i, (name, kind) in enumerate(zip(wanted, kinds, strict=True))])


def column(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c
