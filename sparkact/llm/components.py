"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkact.llm.common import written


def stars(edges: DataFrame) -> DataFrame:
    """(doc_id, component) of every vertex of ``edges`` (columns a, b): the smallest vertex that
    it reaches. Rounds go on until one changes nothing. Each round's edges are written to the
    shared folder; a vertex with very many neighbours is one key of a skew join, and minima are
    combined before the shuffle."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(roots)
