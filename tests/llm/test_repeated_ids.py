"""Rows of one doc_id with different texts, and mark-up that was misread."""

import random
import time
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from test_edges import OPERATORS, ROWS, docs

from sparkact.llm import html_blocks, line_join, suffix_dedup

UNEQUAL = [*ROWS, (2, None), (2, "short"), (2, "a other text, " * 30), (1, None), (None, None)]


@pytest.mark.parametrize("name", OPERATORS)
def test_unequal_texts(spark, name):
    assert OPERATORS[name](docs(spark, UNEQUAL)).collect()


def covered(rows, length=50):
    """By loops: (doc_id, bytes, removed, runs, digest of the rest) of each row, and the rest."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in texts:
        for i in range(len(b) - length + 1) if d is not None else ():
            first[b[i : i + length]] = min(first.get(b[i : i + length], d), d)
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, sha256(rest).hexdigest(), rest))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_unequal_texts(spark, seed):
    r = random.Random(seed)
    parts = ["".join(r.choice("abcé \n") for _ in range(r.choice([40, 60, 120, 300]))) for _ in range(12)]
    rows = [(r.choice([None, *range(40)]), r.choice([None, "", "x", *("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(6))])) for _ in range(120)]
    rows += rows[:10]
    d = docs(spark, rows).repartition(5)
    want = covered(rows)
    assert sorted(map(repr, map(tuple, suffix_dedup.removal_report(d).collect()))) == sorted(repr(w[:5]) for w in want)
    left = [(x.doc_id, x.text or "") for x in suffix_dedup.without_repeats(d).collect()]
    assert sorted(map(repr, left)) == sorted(repr((w[0], w[5].decode("utf-8", "ignore"))) for w in want)


def test_no_table_stays(spark):
    before = {t.name for t in spark.catalog.listTables()}
    held = line_join.dealt(docs(spark, ROWS))
    joined = held.join(held.groupBy("d").agg(F.count("*").alias("c")), "d")
    assert joined.count() == len(ROWS) - 1 and "hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<p>a</p><style-guide>b<p>c</p>", ["a", "b", "c"]),
        ("<svg-icon>x</svg-icon><p>d</p><svg>y</svg>", ["x", "d"]),
        ("<script-loader>z</script-loader><p>q", ["z", "q"]),
        ("<p title=it's>k</p>", ["k"]),
        ("<p title=\"a > b\">k</p>", ["k"]),
        ("<script>a</script ><p>b", ["b"]),
        ("<SVG/>t<svg />u<svg>v", ["tuv"]),
        ("<style>p{}", []),
        ("x<script>never<p>y", ["x"]),
    ],
)
def test_mark_up(html, texts):
    assert [b[0] for b in html_blocks.blocks(html)] == texts


@pytest.mark.parametrize("piece", ["<div>x", "<svg>x", '<a ="b ', "<p title=it's>x</p>", "<", "<!--", "<p a='", '<p a="b" ', "</div>", "<p a=b"])
def test_time_is_linear(piece):
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        html_blocks.blocks(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.2
