"""Search over text and vectors: keyword scores, inverted lists, BM25, exact nearest vectors,
rank fusion and size budgets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from sparkact.functions import nearest as near
from sparkact.functions import text as tx
from sparkact.functions import vectors as vec
from sparkact.functions.names import fresh

RRF = 60
VECTORS_IN_A_BLOCK, QUERIES_IN_A_BLOCK = 4096, 4096


def keyword_scores(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """45 points for a word that equals a term, 20 for one that only contains it."""
    words = fresh("_w", docs)
    score = F.lit(0)
    for t in terms:
        hit = F.when(F.array_contains(words, t), 45).when(F.contains(F.lower(F.col(text)), F.lit(t)), 20).otherwise(0)
        score = score + hit
    return docs.withColumn(words, tx.pretokens(F.col(text))).withColumn("score", score).drop(words).where("score > 0")


def matches_any(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    return docs.where(F.arrays_overlap(tx.pretokens(F.col(text)), F.array(*map(F.lit, terms))))


def matches_all(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    return docs.where(F.size(F.array_except(F.array(*map(F.lit, terms)), tx.pretokens(F.col(text)))) == 0)


def bm25(docs: DataFrame, key: str, terms: list[str], k1: float = 1.2, b: float = 0.75, text: str = "text") -> DataFrame:
    """BM25 over distinct terms, with document counts and lengths of the whole table; one pass
    gathers the counts (a row), another scores."""
    rows = docs.select(key, tx.pretokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    has = [F.array_contains("w", t) for t in terms]
    stats = rows.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *[F.count_if(h).alias(f"df{i}") for i, h in enumerate(has)])
    joined = rows.where(F.arrays_overlap("w", F.array(*map(F.lit, terms)))).withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")  # one row
    score = F.lit(0.0)
    for i, h in enumerate(has):
        idf = F.log((F.col("N") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score = score + F.when(h, idf * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return joined.select(key, score.alias("score"))


def nearest(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): for each query vector (columns query_id, q) the ``k`` vectors
    of greatest cosine, smaller keys first among equals; vectors of another length are skipped.
    All pairs are scored as they stream by; the limit on the rank leaves ``k`` rows of each query
    and task before these are grouped by query. For few queries; :func:`nearest_each` takes many."""
    rows = vectors.select(key, F.col(column).alias("_v"), vec.norm(F.col(column)).alias("_n"))
    asked = query.select("query_id", "q", vec.norm(F.col("q")).alias("_m"))
    lengths = F.col("_n") * F.col("_m")
    score = F.when(lengths == 0, F.lit(0.0)).otherwise(vec.dot(F.col("_v"), F.col("q")) / lengths)
    # As an equality, the lengths would become the join's key, and all vectors of one length one task's.
    scored = rows.crossJoin(asked).where(F.size("_v") - F.size("q") == 0).select("query_id", key, score.alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_each(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The same rows as :func:`nearest`, for a table of queries of any size: vectors and queries are dealt into blocks of a
    bounded size, a task scores a block of each by one product of matrices and keeps ``k`` rows a query."""
    n = max(2, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = lambda size: F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int")
    sizes = F.broadcast(vectors.agg(parts(VECTORS_IN_A_BLOCK).alias("_cs")).crossJoin(query.agg(parts(QUERIES_IN_A_BLOCK).alias("_rs"))))  # a row
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c, by: F.pmod(F.xxhash64(c), F.col(by)).cast("int")
    left = vectors.select(F.col(key).alias("_id"), F.col(column).alias("_v")).crossJoin(sizes).select("_id", "_v", own("_id", "_cs").alias("_c"), every("_rs").alias("_r"))
    right = query.select("query_id", "q").crossJoin(sizes).select("query_id", "q", every("_cs").alias("_c"), own("query_id", "_rs").alias("_r"))
    out = StructType([StructField("query_id", query.schema["query_id"].dataType), StructField(key, vectors.schema[key].dataType), StructField("score", DoubleType())])

    def task(v: pa.Table, q: pa.Table) -> pa.Table:
        order = np.empty(v.num_rows, np.int64)
        order[np.asarray(pc.sort_indices(v["_id"], null_placement="at_start"))] = np.arange(v.num_rows)
        i, j, score = near.best(order, v["_v"], q["q"], k)
        return pa.Table.from_arrays([q["query_id"].take(pa.array(i)), v["_id"].take(pa.array(j)), score], names=["query_id", key, "score"])

    block = ["_c", "_r"]
    scored = left.repartition(n, *block).groupBy(*block).cogroup(right.repartition(n, *block).groupBy(*block)).applyInArrow(task, out)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank from 1."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fused(lists: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (columns key, rank)."""
    out = lists[0].select(key, "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select(key, "rank"))
    return out.groupBy(key).agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"), F.count("*").alias("lists"))


def within_budget(hits: DataFrame, size: str, order: list, budget: int) -> DataFrame:
    """The longest prefix of the ordered hits whose sizes sum up to ``budget`` at most."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
