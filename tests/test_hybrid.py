"""Retrieval by blocks against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkact.operators import hybrid, inverted

CHUNK, REQUEST = "chunk_id long, conversation string, content string, vector array<float>", "query_id long, text string, q array<float>, bound string"


def cosine(a, b):
    a, b = np.float64(np.float32(a)), np.float64(np.float32(b))
    n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return (a * b).sum() / n if n else 0.0


def made(r, n=600):
    vector = lambda: r.choice([None, [0.0] * 4, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)], [r.gauss(0, 1) for _ in range(4)], [1.0, 2.0]])
    chunks = [(i, "hot" if i % 3 else f"c{r.randint(0, 4)}", " ".join(r.choice("ab c de f".split()) for _ in range(r.randint(0, 6))), vector()) for i in range(n)]
    requests = [(q, r.choice(["a", "b de", "", None, "f f a"]), vector(), r.choice(["hot", "c1", None])) for q in range(0, 60)]
    scopes = [(q, c) for q in range(60) for c in r.sample(["hot", "c0", "c1", "c2", "gone"], r.randint(0, 4))]
    return chunks, requests, scopes + scopes[:20]


def test_cosine_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "CHUNKS_IN_A_BLOCK", 50)
    monkeypatch.setattr(hybrid, "REQUESTS_IN_A_BLOCK", 7)
    chunks, requests, scopes = made(random.Random(1))
    frames = [spark.createDataFrame(x, s) for x, s in ((chunks, CHUNK), (requests, REQUEST), (scopes, "query_id long, conversation string"))]
    got = {}
    for r in hybrid.by_cosine(frames[0].where("vector is not null"), frames[1].where("q is not null"), frames[2], 9).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
    for q, _, v, _ in requests:
        pairs = [(-cosine(v, x), i) for i, c, _, x in chunks if v and x and len(v) == len(x) and (q, c) in scopes]
        want = [(i, round(-s, 9)) for s, i in sorted((round(s, 12), i) for s, i in pairs if -s >= 0.2)[:9]]
        have = got.get(q, [])
        assert [s for _, s in have] == [s for _, s in want] and len({i for i, _ in have}) == len(have)
        assert {i for i, s in have if s > want[-1][1]} == {i for i, s in want if s > want[-1][1]} if want else not have


def test_chain(spark):
    r = random.Random(2)
    chunks, requests, scopes = made(r)
    frames = [spark.createDataFrame(x, s) for x, s in ((chunks, CHUNK), (requests, REQUEST), (scopes, "query_id long, conversation string"))]
    index = inverted.build(frames[0], "chunk_id", "content", buckets=4)
    gone, since = ({i for i in range(600) if i % 5 == k} for k in (0, 1))
    ids = lambda x: spark.createDataFrame([(i,) for i in sorted(x)] * 2, "chunk_id long")
    hits = hybrid.retrieved(index, *frames, ids(gone), ids(since), top_k=6, budget=25)
    rows = hits.collect()
    content = {i: t for i, _, t, _ in chunks}
    place = {i: c for i, c, _, _ in chunks}
    assert rows
    for x in rows:
        assert x.chunk_id not in gone | since and (x.query_id, place[x.chunk_id]) in scopes and x.rank <= 6
        assert x.content == content[x.chunk_id] and x.tokens == len(x.content) and x.used <= 25
    for q in {x.query_id for x in rows}:
        own = sorted((x for x in rows if x.query_id == q), key=lambda x: x.rank)
        assert [x.used for x in own] == [sum(y.tokens for y in own[: i + 1]) for i in range(len(own))]
        assert [x.score for x in own] == sorted((x.score for x in own), reverse=True)
    words = [x for x in rows if requests[x.query_id][2] is None]
    assert all(set((requests[x.query_id][1] or "").split()) <= set(x.content.split()) for x in words)
    once, twice = ({tuple(x) for x in hybrid.fingerprints(h).collect()} for h in (hits, hybrid.retrieved(index, frames[0].repartition(7), *frames[1:], ids(gone), ids(since), top_k=6, budget=25)))
    assert once == twice and len(once) == len({x.query_id for x in rows})


def test_no_pair_outside_a_scope_is_made(spark):
    chunks, requests, scopes = made(random.Random(3))
    frames = [spark.createDataFrame(x, s) for x, s in ((chunks, CHUNK), (requests, REQUEST), (scopes, "query_id long, conversation string"))]
    plan = hybrid.by_cosine(frames[0], frames[1], frames[2].where(F.lit(True)), 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_words_equal_all_pairs_without_making_them(spark, monkeypatch):
    """Requests of the same words are answered once a block; no task's rows grow with requests times chunks."""
    monkeypatch.setattr(hybrid, "CHUNKS_IN_A_BLOCK", 40)
    chunks, requests, scopes = made(random.Random(7))
    requests = [(q, ["AB", "c de", "f f ab", "", None, "gone c"][q % 6], v, b) for q, _, v, b in requests]
    frames = [spark.createDataFrame(x, s) for x, s in ((chunks, CHUNK), (requests, REQUEST), (scopes, "query_id long, conversation string"))]
    index = inverted.build(frames[0], "chunk_id", "content", buckets=4)
    found = hybrid.by_words(index, *frames, 5)
    every = index.scored_each(frames[1]).collect()
    place = {i: c for i, c, _, _ in chunks}
    needed = {q: len(set((t or "").lower().split())) for q, t, _, _ in requests}
    want = {}
    for q in needed:
        fits = sorted((-round(r.score, 9), r.key) for r in every if r.query_id == q and r.hits == needed[q] and (q, place[r.key]) in scopes)
        want |= {(q, i): key for i, (_, key) in enumerate(fits[:5])}
    assert {(r.query_id, r["rank"]): r.chunk_id for r in found.collect()} == want and len(want) > 50
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
