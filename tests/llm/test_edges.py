"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkact.llm import bpe_packing, fingerprints, html_blocks, line_join, media, ngram_join, sentencepiece_viterbi, suffix_dedup, toxicity, url_cascade

JSON, RANKS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
LONG = "A long passage of words that stands in several documents, word for word the same. " * 400
ROWS = [
    (1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (5, "one"), (6, "one two"), (7, " \t\n"), (8, "Ünïcode ✓ 漢字 🙂 text"), (9, "x" * 5000), (None, "no id here at all"),
]
MODEL = toxicity.fit(["you idiot", "a nice day", "such an idiot thing", "what a fine day"] * 5, [1, 0, 1, 0] * 5)

OPERATORS = {
    "packing": lambda d: bpe_packing.packed(d, JSON, RANKS),
    "fingerprints": fingerprints.fingerprinted,
    "lines": line_join.deduplicated,
    "line_report": line_join.removal_report,
    "media": media.stored_texts,
    "ngrams": ngram_join.components,
    "one_of_each": ngram_join.one_of_each,
    "sentencepiece": lambda d: sentencepiece_viterbi.round_trips(d, PIECES),
    "passages": suffix_dedup.without_repeats,
    "passage_report": suffix_dedup.removal_report,
    "toxic": lambda d: toxicity.scored(d, MODEL),
    "accepted": lambda d: toxicity.accepted(d, MODEL),
}


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.withColumns({"spans": F.lit(1), "flags": F.lit("x"), "n": F.lit(2), "label": F.lit("y"), "kind": F.lit(3), "id": F.lit(4), "component": F.lit(5), "token": F.lit(6), "bucket": F.lit(7)} | {c: F.lit(c) for c in CLASHING})


CLASHING = ["_flags", "_doc", "_gone", "_spans", "_near", "_lines", "_removed", "row", "d", "p", "ps", "late", "kept", "done", "a.b", "score", "host"]


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    found = OPERATORS[name](docs(spark, ROWS)).collect()
    assert found


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, [])).count() == 0


def test_kept_columns(spark):
    d = docs(spark, ROWS)
    for name in ("one_of_each", "passages", "accepted", "lines"):
        found = OPERATORS[name](d)
        assert found.columns == d.columns
        for r in found.collect():
            assert [r[c] for c in CLASHING] == CLASHING and (r["spans"], r["flags"], r["n"], r["id"]) == (1, "x", 2, 4)


def test_values_of_edge_rows(spark):
    """Null, empty and short texts, repeated rows and a row without a doc_id."""
    d = docs(spark, ROWS)
    texts = sorted((r.doc_id or 0, r.text or "") for r in OPERATORS["lines"](d).collect())
    assert texts == sorted((i or 0, t if i != 2 and t else "") for i, t in ROWS)
    report = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in OPERATORS["passage_report"](d).collect()}
    size = len(LONG.encode())
    assert {(1, size, 0, 0), (2, size, size, 1), (3, 0, 0, 0), (4, 0, 0, 0), (5, 3, 0, 0), (9, 5000, 0, 0), (None, 17, 0, 0)} <= report
    stored = {(r.doc_id, r.n_bytes, r.payload_bytes) for r in OPERATORS["media"](d).collect()}
    assert {(3, 0, 64), (4, 0, 64), (5, 3, 64), (9, 5000, 5056), (2, size, -(-size // 64) * 64)} <= stored
    pieces = [r for r in OPERATORS["packing"](d).collect() if r.doc_id in (3, 4)]
    assert sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in pieces) == [(3, 0, 1, 1), (4, 0, 1, 1)]
    scores = {r.doc_id: r.score for r in OPERATORS["toxic"](d).collect()}
    assert scores[3] == scores[4] == scores[7] and scores[1] == scores[2]
    trips = {(r.doc_id, r.n_ids, r.round_trip) for r in OPERATORS["sentencepiece"](d).collect()}
    assert {(3, 0, True), (4, 0, True)} <= trips and all(t[2] for t in trips)
    classes = {(r.doc_id, r.n_shingles, r.component_id) for r in OPERATORS["ngrams"](d).collect()}
    assert {(3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 6), (7, 0, 7)} <= classes and {c[2] for c in classes if c[0] in (1, 2)} == {1}
    prints = {(r.doc_id, r.n_chars, r.fingerprint) for r in OPERATORS["fingerprints"](d).collect()}
    assert len({f for i, _, f in prints if i in (1, 2)}) == 1 and {n for i, n, _ in prints if i in (3, 4)} == {0}


def test_several_labels_of_one_document(spark):
    d = spark.createDataFrame([(i, "you idiot" if i % 2 else "a fine day") for i in range(40)] + [(1, "a other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (3, 0)], "doc_id long, toxic int")
    one, two = (toxicity.trained(x, y) for x, y in ((d, labels), (d.repartition(3), labels.repartition(4))))
    assert one.weights == two.weights and one.score("idiot") > one.score("fine")
    assert {*d.columns} - {"flags"} <= {*OPERATORS["lines"](d).columns}


def test_one_of_each_keeps_clean(spark):
    ids = sorted((r.doc_id for r in ngram_join.one_of_each(docs(spark, ROWS)).collect()), key=lambda x: (x is None, x or 0))
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, None]


def test_pages(spark):
    rows = [(1, "http://a.b/c", None), (2, None, ""), (3, "no scheme", "<p>unclosed <b>text"), (4, "x://", "<html><body><article><p>Hello &amp; good   bye</p></article><footer>copyright</footer></body></html>"), (4, "x://", "<p>" * 500 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {(r.page_id, r.text) for r in html_blocks.extracted(pages).collect()}
    assert (1, "") in got and (2, "") in got and (4, "Hello & good bye") in got
    judged = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_cascade.judged(pages, [("block", "a.b/c"), ("allow", "b/")]).collect()}
    assert {(1, "a.b", "/c", "b/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow")} - judged == {(1, "a.b", "/c", "b/", "allow")} and (1, "a.b", "/c", "a.b/c", "block") in judged
    assert html_blocks.extracted(pages.limit(0)).count() == 0
    assert url_cascade.judged(pages.limit(0), [("block", "a.b/c")]).count() == 0


def test_media_with_tag_bytes_in_the_text():
    for size in (64, 128, 192, 896, 960, 1024, 1856):
        for at in range(size - 2):
            payload = bytearray(b"x" * size)
            payload[at : at + 3] = b"TAG"
            stored = media.wrap(bytes(payload))
            parsed = media.parse(stored)
            assert media.unwrap(stored, parsed) == payload and not parsed["id3v1"]
    tagged = media.parse(stored + b"TAG" + b"title".ljust(125))
    assert tagged["id3v1"] and tagged["offsets"] == parsed["offsets"] and not tagged["skipped"]


def test_line_stage_removes_short_repeats(spark):
    from corpus_pipeline import line_stage

    rows = [(1, "All rights reserved.\n\nOne of these"), (2, "two\n\nAll rights reserved.\nOne of those"), (3, "two\nAll rights reserved\ntwo\n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.text for r in line_stage(spark, d, "").collect()}
    assert got == {1: rows[0][1], 2: "two\n\nOne of those", 3: "All rights reserved\n"}
