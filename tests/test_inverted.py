"""The full-text index against loops over all texts."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkact.operators import inverted
from sparkact.search_queries import index_bm25_each


def looped(text):
    """Terms by going through the characters one by one."""
    out, run, kind = [], "", None

    def close():
        if kind == "a":
            out.append(run.lower())
        elif kind == "c":
            out.extend(run[i : i + w] for w in (2, 3) for i in range(len(run) - w + 1))

    for ch in (text or "") + " ":
        now = "a" if ch.isascii() and ch.isalnum() else "c" if re.match("[㐀-䶿一-鿿豈-﫿]", ch) else None
        if now != kind:
            close()
            run, kind = "", now
        run += ch
    return out


def test_codec():
    r = np.random.default_rng(1)
    for v in (np.zeros(0, np.int64), np.arange(300), r.integers(0, 2**62, 1000), np.array([0, 127, 128, 2**63 - 1])):
        for edges in ([0, len(v)], [0, len(v) // 3, len(v) // 2, len(v)]):
            got = inverted.packed(v, np.array(edges))
            assert (inverted.unpacked(got) == v).all() and len(got) == len(edges) - 1
            assert (inverted.unpacked(got[1:]) == v[edges[1] :]).all()


def corpus():
    r = random.Random(4)
    words = ["alpha", "Beta", "gamma1", "知识库", "迁", "迁移方案", "İx", "K9", "the", "the", "the"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 30])))) for i in range(3000)]
    return [*rows, (3000, None), (3001, ""), (-7, "alpha rare"), (3002, "the " * 20_000), (None, "alpha")]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumns({c: F.lit(c) for c in ("key", "term", "tf", "dl", "bucket")})
    return inverted.build(docs.repartition(5), buckets=16)


def scan(asked):
    docs = [(i, looped(t)) for i, t in corpus() if i is not None]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    names = set(looped(asked))
    idf = {}
    for t in names:
        df = sum(t in w for _, w in docs)
        raw = math.log((n - df + 0.5) / (df + 0.5))
        idf[t] = raw if raw > 0 else 1e-6
    out = {}
    for i, w in docs:
        hits = [t for t in names if t in w]
        if hits:
            out[i] = (len(hits) == len(names), sum(idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in hits))
    return out


@pytest.mark.parametrize("asked", ["the Alpha beta", "知识库迁移", "rare", "k9 x", "迁", "unseen", "", "the unseen"])
def test_equals_scan(index, asked):
    want = scan(asked)
    names = set(inverted.terms_of(asked))
    assert names == set(looped(asked))
    assert {r.key for r in index.any_of(asked).collect()} == set(want)
    assert {r.key for r in index.all_of(asked).collect()} == {i for i, (every, _) in want.items() if every and names}
    got = {r.key: r.score for r in index.scored(asked).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i][1], rel_tol=1e-9) for i in want)


def test_many_queries(spark, index):
    asked = {1: "the Alpha beta", 2: "知识库迁移", 3: "", 4: None, 5: "rare rare"}
    found = index.scored_each(spark.createDataFrame(list(asked.items()), "query_id long, text string")).collect()
    for i, text in asked.items():
        want = scan(text or "")
        got = {r.key: r.score for r in found if r.query_id == i}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k][1], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("shards, lists", [(1, 1000), (7, 2)])
def test_best_of_many_queries(spark, index, monkeypatch, shards, lists):
    """The first of all scores, equal ones by key, whatever the shards; rows of one query_id ask together, each term once."""
    monkeypatch.setattr(inverted, "SHARD_LISTS", lists)
    monkeypatch.setattr(inverted, "SHARD_DOCS", 4000 // shards)
    monkeypatch.setattr(inverted, "OPEN", 500)
    monkeypatch.setattr(inverted, "SENT", 0 if shards > 1 else 100)
    asked = [(1, "the Alpha beta"), (2, "知识库迁移"), (3, ""), (4, None), (5, "rare rare"), (6, "beta ALPHA the"), (7, "unseen k9"), (8, "the"), (8, "the unseen gamma1"), (None, "迁移")]
    frame = spark.createDataFrame(asked, "query_id long, text string")
    with_partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        found = index.best_each(frame, 20, digits=6).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_partitions)
    keyed = {}
    for i, w in corpus():
        if i is not None:
            keyed.setdefault(i, set()).update(looped(w))
    for i in {i for i, _ in asked}:
        text = " ".join(t or "" for j, t in asked if i == j)
        want = sorted(((-round(score, 6), key) for key, (_, score) in scan(text).items()))[:20]
        got = sorted((r.rank, r.key, r.score, r.hits) for r in found if r.query_id == i)
        assert [(r, k, s) for r, k, s, _ in got] == [(r + 1, k, -s) for r, (s, k) in enumerate(want)]
        assert all(h == len(keyed[k] & set(looped(text))) for _, k, _, h in got)


def test_repeated_keys_add_up(spark):
    """Documents of one key are one answer, as in the list of all scores."""
    rows = [(k, " ".join(["a"] * (k % 3 + 1) + ["b"] * (k % 2) + ["c"])) for k in [5, -3, 8, 0, 2, 2, 7, 2**62, -(2**62)] * 9]
    index = inverted.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    frame = spark.createDataFrame([(1, "a b"), (2, "c b x")], "query_id long, text string")
    every = sorted(((r.query_id, -round(r.score, 6), r.key, r.hits) for r in index.scored_each(frame).collect()))
    best = sorted(((r.query_id, -r.score, r.key, r.hits) for r in index.best_each(frame, 100, digits=6).collect()))
    assert best == every and any(h > 2 for *_, h in best)
    assert index.best_each(frame.where("false"), 3).count() == 0
    empty = inverted.build(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.best_each(frame, 3).count() == 0


def test_no_row_for_a_query_and_a_document(spark, tmp_path):
    """What the query shuffles follows the documents and not their pairs with the items, of which each has a term of each."""
    docs, items, context = 3000, 80, spark.sparkContext._jsc.sc()
    spark.range(docs).select(F.col("id").alias("doc_id"), F.lit("some common words here").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(items).select(F.col("id").alias("item_id"), F.concat(F.lit("common words x"), "id").alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")

    def shuffled():
        """Records that each stage so far has written to shuffles."""
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = shuffled()
    got = sorted((r.item_id, r.rank, r.doc_id, r.hits) for r in index_bm25_each(spark, str(tmp_path)).collect())
    assert got == [(i, k + 1, k, 2) for i in range(items) for k in range(5)]
    assert 0 < sum(n for i, n in shuffled().items() if i not in before) < docs * items / 10


def test_reads_only_the_terms_folders(spark, index):
    """Three terms open the folders of three buckets at most, and the filter on the term reaches the scan."""
    names = ["alpha", "beta", "rare"]
    plan = index.blocks(names)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    files = {r[0] for r in index.blocks(names).select(F.input_file_name()).distinct().collect()}
    buckets = {r.b for r in spark.createDataFrame([(n,) for n in names], "t string").select(inverted.bucket_of(F.col("t"), 16).alias("b")).collect()}
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in files} == buckets
    assert index.blocks(names)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_pieces_of_a_task_are_merged(monkeypatch):
    """Small pieces, merged again, have the postings of one piece."""
    rows = [(k, ["a", "b", "a"] if k % 2 else ["b", "c"]) for k in [5, -3, 8, 0, 2, 2, 7] * 40]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], names=["key", "terms"])
    whole = list(inverted.blocks([batch]))
    monkeypatch.setattr(inverted, "FLUSH", 50)
    monkeypatch.setattr(inverted, "SLICE", 3)
    pieces = list(inverted.blocks([batch]))
    assert len(pieces) > 5
    monkeypatch.setattr(inverted, "BLOCK", 32)
    rows = sorted((r for b in pieces for r in b.to_pylist()), key=lambda r: (r["term"], r["first_key"]))
    schema = pa.schema([("bucket", pa.int32()), *[inverted.BLOCK_SCHEMA.field(c) for c in inverted.OPENED]])
    again = list(inverted.merged([pa.RecordBatch.from_pylist([{"bucket": ord(r["term"])} | {c: r[c] for c in inverted.OPENED} for r in rows], schema=schema)]))
    show = lambda found: sorted(tuple(p.values()) for b in inverted.opened([b.select(list(inverted.OPENED)) for b in found]) for p in b.to_pylist())
    assert show(again) == show(whole) == show(pieces)
    assert all(r["bucket"] == ord(r["term"]) and r["n"] <= 32 for b in again for r in b.to_pylist())


def test_long_lists_are_cut(index):
    sizes = [r.n for r in index.blocks(["the"]).collect()]
    assert max(sizes) <= inverted.BLOCK and len(sizes) > 1


def test_empty(spark):
    empty = inverted.build(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.totals() == (0, 0) and empty.scored("a").count() == empty.any_of("a").count() == 0


def test_memory_does_not_follow_the_batch():
    """A batch of many full blocks is opened and merged piece by piece."""
    n, size = 3000, 1024
    edges = np.arange(n + 1) * size
    column = inverted.packed(np.ones(n * size, np.int64), edges)
    row = [pa.array(["t"] * n), pa.array([size] * n, pa.int32()), pa.array(edges[:-1]), column, column, column]
    blocks = pa.RecordBatch.from_arrays(row, names=list(inverted.OPENED))
    got = list(inverted.opened([blocks]))
    assert sum(b.num_rows for b in got) == n * size and max(b.num_rows for b in got) <= inverted.OPEN + size
    tracemalloc.start()
    for _ in inverted.opened([blocks]):
        pass
    for _ in inverted.merged([pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), *row], names=["bucket", *inverted.OPENED])]):
        pass
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_texts_are_cut_in_tasks_as_in_columns(spark, monkeypatch):
    monkeypatch.setattr(inverted, "READ", 50)
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "B", "7", " ", "K", "İ", "é", "知", "识", "库", "﨑", "한", "🙂", "\x00", "_"]) for _ in range(r.choice([0, 1, 9, 60]))) for _ in range(500)] + [None, "", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["key", "text"]).slice(3)
    got = {k: sorted(t) for b in inverted.tokenised([batch]) for k, t in zip(b["key"].to_pylist(), b["terms"].to_pylist(), strict=True)}
    want = {x.k: sorted(x.t) for x in spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", inverted.terms(F.col("text")).alias("t")).collect()}
    assert got == {k: t for k, t in want.items() if k >= 3} == {k: sorted(looped(texts[k])) for k in range(3, len(texts))}
