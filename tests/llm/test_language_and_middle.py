"""Language identification by held-out accuracy, fill-in-the-middle against loops over units."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sparkact.llm import fill_middle, language
from sparkact.llm.queries import op11_language

UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"^[^ \t-\r]+|[ \t-\r]+[^ \t-\r]*"}


@pytest.mark.parametrize("unit", UNITS)
def test_cuts_equal_loops(unit):
    r = random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice("ab \n\n\té漢🙂\r<") for _ in range(r.choice([0, 1, 5, 40])))
        units = re.findall(UNITS[unit], text)
        assert "".join(units) == text
        d = [r.randrange(2**32) for _ in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in d[:2])
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        n, form, before, inside, out = fill_middle.transformed_text(text, d, 80, 30, unit)
        want = "plain" if not text or d[2] % 100 >= 80 else "spm" if d[3] % 100 < 30 else "psm"
        assert (n, form) == (len(units), want)
        if form == "plain":
            assert (before, inside, out) == (None, None, text)
        else:
            assert (before, inside) == (len(p), len(m))
            assert out == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_select():
    r = random.Random(2)
    for size in (1, 2, 7, 64, 1000):
        where = sorted(r.sample(range(size), r.randint(1, size)))
        marks = sum(1 << i for i in where)
        assert [fill_middle.select(marks, k, size) for k in range(len(where) + 1)] == [*where, size]


def docs(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return d.withColumns({c: F.lit(c) for c in ("n", "form", "output", "draws", "letters", "held_out", "score", "excerpt", "h", "k", "a.b")})


def test_middle_edges(spark):
    texts = {1: None, 2: "", 3: "a\nb\nc", 4: "has <M> in it\n", 5: "\n\n\n", 6: "line\n" * 100_000, 7: "no end", 8: "< P>\n<\nS>"}
    rows = [(i, t, None) for i, t in texts.items()] + [(3, texts[3], "x"), (None, "one\ntwo", None)]
    made = fill_middle.transformed(docs(spark, rows))
    got = made.select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("restored")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "one\ntwo" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.restored == text and r.n == len(re.findall(UNITS["line"], text))
        assert (r.form == "plain") == (r.doc_id in (1, 2, 4)) == (r.prefix_chars is None)
        if r.form != "plain":
            h = sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
            a, b = sorted(int(h[i : i + 8], 16) % (r.n + 1) for i in (0, 8))
            units = re.findall(UNITS["line"], text)
            assert (r.prefix_chars, r.middle_chars) == (len("".join(units[:a])), len("".join(units[a:b])))
            assert r.form == ("spm" if int(h[24:32], 16) % 100 < 50 else "psm")
    assert fill_middle.transformed(docs(spark, [])).count() == 0


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op11_language(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == d.count()
    held = [r for r in got if r.held_out]
    assert 200 < len(held) < 300 and sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.985
    sure = [r for r in held if not r.rejected]
    assert len(sure) >= 0.97 * len(held) and sum(r.lang_pred == r.lang for r in sure) / len(sure) >= 0.99


def test_language_edges(spark):
    one, two = "the cat sat on the mat and the dog sat on the log ", "der hund und die katze sitzen auf der matte und dem holz "
    rows = [(i, (one, two)[i % 2] * 3, ("en", "de")[i % 2]) for i in range(60)]
    model = language.trained(docs(spark, rows))
    asked = [(100, None, "en"), (101, "", None), (102, "123 !? \n", "en"), (103, two, None), (104, "The Dog and the Cat", None), (105, (one * 40_000), "de"), (103, two, None), (None, one, "en"), (106, "é́", None)]
    got = {(r.doc_id, r.lang_pred, r.score > 0.5) for r in language.predicted(docs(spark, asked), model).collect()}
    assert {(100, "und", False), (101, "und", False), (102, "und", False), (103, "de", True), (104, "en", True), (105, "en", True), (None, "en", True)} <= got
    assert language.predicted(docs(spark, asked), model).count() == len(asked)
    assert language.predicted(docs(spark, []), model).count() == 0
    assert {r.lang for r in language.identified(docs(spark, [(1, "zzz", None), (2, two, None)]), model).collect()} == {"und", "de"}
    none = language.trained(docs(spark, []))
    assert {(r.lang_pred, r.score) for r in language.predicted(docs(spark, asked), none).collect()} == {("und", 0.0)}


def test_language_learns_from_the_rest_only(spark):
    """Other labels and texts of held-out rows, other sources and an order change nothing."""
    rows = [(i, "alpha beta gamma" if i % 2 else "uno dos tres", "x" if i % 2 else "y") for i in range(80)]
    d = docs(spark, rows)
    changed = d.withColumn("lang", F.when(language.is_held_out(F.col("doc_id")), "z").otherwise(F.col("lang"))).withColumn("text", F.when(language.is_held_out(F.col("doc_id")), "other").otherwise(F.col("text")))
    assert language.trained(d).dictionaries == language.trained(changed.repartition(5)).dictionaries
