"""The toxicity classifier: loss and gradient against loops, sentences, features, held-out figures."""

import math
import random
import zlib

import numpy as np
import pytest

from sparkact.llm import toxicity as tox


def test_loss_and_gradient_equal_loops():
    r = random.Random(3)
    bags = [[np.array(sorted(r.sample(range(6), r.randint(0, 4))), np.int32) for _ in range(n)] for n in (9, 5, 5)]
    y = np.array([float(r.randint(0, 1)) for _ in range(9)])
    column = np.array([0, 1, -1, 2, 3, 4])  # feature 2 is left out

    def loss(w):
        score = lambda b: 1 / (1 + math.exp(-(w[-1] + sum(w[column[i]] for i in b if column[i] >= 0))))
        out = -sum(math.log(score(b) if t else 1 - score(b)) for b, t in zip(bags[0], y, strict=True)) / 9
        out += 4.0 * sum((score(a) - score(b)) ** 2 for a, b in zip(bags[1], bags[2], strict=True)) / 5
        return out + 0.01 * sum(x * x for x in w[:-1]) / 2

    texts, left, right = (tox.csr(b, column) for b in bags)
    w = np.array([r.gauss(0, 1) for _ in range(6)])
    value, g = tox.objective(w, texts, y, left, right, 4.0, 0.01)
    assert math.isclose(value, loss(w), rel_tol=1e-9)
    for i in range(6):
        step = np.eye(6)[i] * 1e-6
        assert math.isclose(g[i], (loss(w + step) - loss(w - step)) / 2e-6, rel_tol=1e-4, abs_tol=1e-7)


def test_terms_are_swapped_inside_sentences():
    pairs = tox.counterfactuals("The woman sings. Nobody hears! A muslim and a christian\nwalk on", 0)
    assert len(pairs) == 2
    (a, b), (c, d) = pairs
    assert a - b == {"woman"} and b - a <= set(tox.SWAPS["woman"]) and a & b == {"the", "sings"}
    assert c - d <= {"muslim", "christian"} and "walk" not in c and "walk" not in d
    (a, b), = tox.counterfactuals("no group. at all", 1)
    assert {"at", "all"} < a and len(a - b) == len(b - a) == 1
    (a, b), = tox.counterfactuals(None, 5)
    assert len(a) == len(b) == 1


def test_chance_keeps_no_feature():
    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(r.sample(words, 40)) for _ in range(300)]
    labels = [int(r.random() < 0.12) for _ in texts]
    assert len(set(tox.fit(texts, labels).weights) - set(tox.TERMS)) <= 3
    marked = [t + " scoundrel" if y else t for t, y in zip(texts, labels, strict=True)]
    assert tox.fit(marked, labels).weights["scoundrel"] > 0.5


@pytest.mark.parametrize("sf, caught, area", [("sf0.01", 0.6, 0.85), ("sf0.1", 0.85, 0.95)])
def test_held_out(spark, sf, caught, area):
    at = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{at}/documents.parquet").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    known, asked = [r for r in rows if not held(r)], [r for r in rows if held(r)]
    model = tox.fit([r.text for r in known], [r.toxic for r in known])
    good, bad = ([model.score(r.text) for r in asked if r.toxic == k] for k in (0, 1))
    assert sum(s >= 0.3 for s in bad) >= caught * len(bad) and sum(s >= 0.3 for s in good) <= 0.02 * len(good)
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) >= area
