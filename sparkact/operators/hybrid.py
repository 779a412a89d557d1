"""Retrieval by words and vectors for a table of requests, each within what it may see.

Requests (query_id, text, q, bound) and their scopes (query_id, conversation) meet chunks
(chunk_id, conversation, content, vector) by conversation only, so no pair outside a scope is made.
Scores of vectors are computed in blocks: a conversation's chunks and requests are salted into
blocks of a bounded size, a task scores one block of each against the other and keeps the best k of
each request; the partial lists are merged by request, k rows of each task at most. Words are answered in such blocks too. No limit drops a
candidate that would be among the best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkact.functions import nearest as near
from sparkact.operators.inverted import Index, terms

# The least cosine of a candidate, what a chunk of the request's own conversation gains, the constant of the fusion.
LEAST_COSINE, SAME_CONVERSATION, RRF = 0.20, 0.001, 60
DIGITS = 9
CHUNKS_IN_A_BLOCK, REQUESTS_IN_A_BLOCK = 4096, 1024
SCORED = "query_id long, chunk_id long, score double"
WORDED = "words string, conversation string, chunk_id long, score double"
WORDED_SCHEMA = pa.schema([("words", pa.string()), ("conversation", pa.string()), ("chunk_id", pa.int64()), ("score", pa.float64())])
SCORED_SCHEMA = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])


def candidates_for(top_k: int) -> int:
    return min(max(top_k * 4, 20), 48)


def best_of_block(chunks: pa.Table, requests: pa.Table, k: int, floor: float) -> pa.Table:
    """The best ``k`` chunks of a block for each of its requests, smaller ids first among equals."""
    ids = np.asarray(chunks["chunk_id"]).astype(np.int64)
    i, j, score = near.best(ids, chunks["vector"], requests["q"], k, floor, DIGITS)
    return pa.Table.from_arrays([requests["query_id"].take(pa.array(i)), pa.array(ids[j], pa.int64()), score], schema=SCORED_SCHEMA)


def best_of_words(postings: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best ``k`` chunks of a block that have all terms, for each list of terms ``asked`` (words, joined by spaces)."""
    coded = postings["term"].combine_chunks().dictionary_encode()
    code, keys, parts = np.asarray(coded.indices), np.asarray(postings["key"]), np.asarray(postings["part"])
    order = np.lexsort((keys, code))
    keys, parts = keys[order], parts[order]
    ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
    place = {t: slice(int(e - n), int(e)) for t, e, n in zip(coded.dictionary.to_pylist(), ends, np.diff(ends, prepend=0), strict=True)}
    found = []
    for words, conversation in zip(asked["words"].to_pylist(), asked["conversation"].to_pylist(), strict=True):
        names = words.split(" ")
        if not all(n in place for n in names):
            continue
        first, *rest = sorted((place[n] for n in names), key=lambda x: x.stop - x.start)
        hits, score = keys[first], parts[first]
        for x in rest:  # rarest first, so that a search costs little
            at = np.searchsorted(keys[x], hits)
            fits = keys[x][np.minimum(at, x.stop - x.start - 1)] == hits
            hits, score = hits[fits], score[fits] + parts[x][at[fits]]
        top = np.lexsort((hits, -np.round(score, DIGITS)))[:k]
        if len(top):
            found.append((words, conversation, hits[top], score[top]))
    n = [len(x[2]) for x in found]
    owner = pa.array(np.repeat(np.arange(len(n)), n).astype(np.int64))
    named = [pa.array([x[c] for x in found], WORDED_SCHEMA.field(c).type).take(owner) for c in (0, 1)]
    ids, scores = (np.concatenate([x[c] for x in found]) if found else [] for c in (2, 3))
    return pa.Table.from_arrays([*named, pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], schema=WORDED_SCHEMA)


def merged(partial: DataFrame, k: int, *by: str) -> DataFrame:
    """The best ``k`` of each request (or of each ``by``) out of partial lists, with their rank from 0. The rank's limit
    works in each task before the rows of a request meet. Scores are compared by nine digits, since the last
    ones depend on the order in which a sum was made."""
    best = W.partitionBy(*(by or ("query_id",))).orderBy(F.desc(F.round("score", DIGITS)), "chunk_id")
    return partial.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)


def by_cosine(chunks: DataFrame, requests: DataFrame, scopes: DataFrame, k: int, floor: float = LEAST_COSINE) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` chunks in a request's scope of greatest cosine, ``floor`` at least."""
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    asked = requests.select("query_id", "q").join(scopes.select("query_id", "conversation").distinct(), "query_id")
    chunk_blocks = chunks.groupBy("conversation").agg(F.count("*").alias("n")).select("conversation", parts("n", CHUNKS_IN_A_BLOCK).alias("cs"))
    request_blocks = asked.groupBy("conversation").agg(F.count("*").alias("n")).select("conversation", parts("n", REQUESTS_IN_A_BLOCK).alias("rs"))
    sizes = chunk_blocks.join(request_blocks, "conversation")  # conversations that nobody asks for go here
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = chunks.join(sizes, "conversation").select("conversation", "chunk_id", "vector", own("chunk_id", "cs").alias("c"), every("rs").alias("r"))
    right = asked.join(sizes, "conversation").select("conversation", "query_id", "q", every("cs").alias("c"), own("query_id", "rs").alias("r"))
    block = ["conversation", "c", "r"]
    task = lambda key, x, y: best_of_block(x, y, k, floor)
    return merged(left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(task, SCORED), k)


def by_words(index: Index, chunks: DataFrame, requests: DataFrame, scopes: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` chunks in a request's scope of greatest BM25 that have all terms of its text.

    Requests of the same terms ask a conversation once. The postings of a block of its chunks meet these lists of terms in one
    task, which keeps ``k`` chunks of each; so no row is made for a chunk that has a term, nor for all that have all."""
    asked = requests.select("query_id", F.array_join(F.array_sort(F.array_distinct(terms(F.col("text")))), " ").alias("words")).where("words <> ''")
    placed = asked.join(scopes.select("query_id", "conversation").distinct(), "query_id")
    wanted = asked.select(F.explode(F.split("words", " ")).alias("term")).distinct()
    sizes = chunks.groupBy("conversation").agg(F.ceil(F.count("*") / CHUNKS_IN_A_BLOCK).cast("int").alias("cs"))
    places = chunks.select("chunk_id", "conversation").join(sizes, "conversation").select(F.col("chunk_id").alias("key"), "conversation", F.pmod(F.xxhash64("chunk_id"), F.col("cs")).cast("int").alias("c"))
    left = index.parts(wanted).join(places, "key").select("conversation", "c", "term", "key", "part")
    right = placed.select("words", "conversation").distinct().join(sizes, "conversation").select("conversation", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), "words")
    task = lambda x, y: best_of_words(x, y, k)
    partial = left.groupBy("conversation", "c").cogroup(right.groupBy("conversation", "c")).applyInArrow(task, WORDED)
    found = merged(partial, k, "words", "conversation").drop("rank")
    return merged(placed.join(found, ["words", "conversation"]).select("query_id", "chunk_id", "score"), k)


def fused(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) by reciprocal ranks of both lists."""
    both = vectors.select("query_id", "chunk_id", "rank").unionByName(words.select("query_id", "chunk_id", "rank"))
    return both.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (RRF + F.col("rank") + 1)).alias("score"))


def within(hits: DataFrame, budget: int) -> DataFrame:
    """The hits of each request up to the first that doesn't fit into what is left of ``budget`` bytes."""
    order = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)  # at most top_k rows a request
    return hits.withColumn("used", F.sum("tokens").over(order)).where(F.col("used") <= budget)


def retrieved(index: Index, chunks: DataFrame, requests: DataFrame, scopes: DataFrame, denied: DataFrame, denied_since: DataFrame | None = None, top_k: int = 8, budget: int = 4096) -> DataFrame:
    """(query_id, rank from 1, chunk_id, conversation, score, tokens, used, content) of each request's hits.

    Chunks ``denied`` (chunk_id) are no candidates. Candidates of both lists are fused, those of the request's
    ``bound`` conversation gain SAME_CONVERSATION, the ``top_k`` best get their contents; those that were
    ``denied_since`` then are taken out again, and contents are kept up to ``budget`` bytes. A request without a
    vector, or none of whose chunks is near, is answered by words only; one without terms by vectors only.
    Equal scores are ordered by chunk_id."""
    allowed = chunks.join(denied.select("chunk_id").distinct(), "chunk_id", "left_anti")
    k = candidates_for(top_k)
    vectors = by_cosine(allowed.where("vector is not null"), requests.where("q is not null"), scopes, k)
    both = fused(vectors, by_words(index, allowed, requests, scopes, k)).join(allowed.select("chunk_id", "conversation"), "chunk_id").join(requests.select("query_id", "bound"), "query_id")
    boosted = both.withColumn("score", F.col("score") + F.when(F.col("conversation") == F.col("bound"), SAME_CONVERSATION).otherwise(0.0))
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "chunk_id")
    top = boosted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).drop("bound", "conversation")
    hits = top.join(chunks.select("chunk_id", "conversation", "content"), "chunk_id").withColumn("tokens", F.octet_length("content").cast("long"))
    if denied_since is not None:
        hits = hits.join(denied_since.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return within(hits, budget).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "conversation", "score", "tokens", "used", "content")


def fingerprints(hits: DataFrame) -> DataFrame:
    """(query_id, hits, fingerprint): a digest of each request's answer that a repetition gives again; times are no part of it."""
    line = F.concat_ws(":", "rank", "chunk_id", F.sha2("content", 256), F.format_string("%.6f", "score"))
    by = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))  # top_k rows
    return by.select("query_id", "hits", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("fingerprint"))

