"""Nearest vectors of many queries, against plain loops."""

import math
import random

from sparkact.operators import retrieval as ret


def test_nearest_answers_every_query(spark):
    r = random.Random(4)
    vectors = {i: [r.uniform(-1, 1) for _ in range(5)] for i in range(300)}
    d = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(7)
    asked = d.where("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    cosine = lambda x, y: sum(map(float.__mul__, x, y)) / math.hypot(*x) / math.hypot(*y)
    expected = {}
    for i in range(0, 300, 3):
        order = sorted(vectors, key=lambda j: (-cosine(vectors[i], vectors[j]), j))
        expected |= {(i, rank): j for rank, j in enumerate(order[:4], 1)}
    found = ret.nearest(d, asked, 4)
    assert {(x.query_id, x["rank"]): x.vec_id for x in found.collect()} == expected
    assert "hashpartitioning(size" not in found._jdf.queryExecution().toString()


def test_many_queries_in_blocks(spark, monkeypatch):
    """Blocks give what streaming all pairs gives, of odd vectors and copies too."""
    monkeypatch.setattr(ret, "VECTORS_IN_A_BLOCK", 60)
    monkeypatch.setattr(ret, "QUERIES_IN_A_BLOCK", 20)
    r = random.Random(5)
    odd = [None, [], [0.0] * 5, [float("nan")] * 5, [float("inf"), 1.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0, 0.0], [1.0, 2.0], [1e-200] * 5, [1e200] * 5, [1e-160, 0.0, 0.0, 0.0, 1e-158]]
    rows = [(i, r.choice(odd) if i % 9 == 0 else [1.0, -1.0, 0.5, 0.25, 3.0] if i % 4 == 0 else [r.gauss(0, 1) for _ in range(5)]) for i in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    asked = d.where("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    found, plain = ret.nearest_each(d, asked, 6), ret.nearest(d, asked, 6)
    show = lambda x: sorted(map(repr, x.select("query_id", "vec_id", "score", "rank").collect()))
    assert show(found) == show(plain) and found.count() > 500
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    assert ret.nearest_each(d.limit(0), asked, 6).count() == ret.nearest_each(d, asked.limit(0), 6).count() == 0
