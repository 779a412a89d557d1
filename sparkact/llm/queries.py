"""Queries ``op1_`` to ``op13_`` and the pipeline, over the tables of a directory, and the SQL
that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkact.llm import bpe_packing, fill_middle, fingerprints, html_blocks, language, line_join, media, ngram_join, prefix_trie, sentencepiece_viterbi, suffix_dedup, toxicity, url_cascade
from sparkact.llm.common import only, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = only(table(spark, sf_dir, "pages"), "page_id", "url")
    return url_cascade.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.round_trips(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.removal_report(table(spark, sf_dir, "documents"), exact=1)


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(table(spark, sf_dir, "documents"))


def op8_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predicted(docs, language.trained(docs))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transformed(table(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50, unit="line")
    sha = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_toxicity, op3_url_filter, op4_suffix_dedup, op5_sentencepiece, op6_line_dedup, op7_mpeg_audio, op8_canonical_digest, op9_packing, op10_ngram_jaccard, op11_language, op12_fill_middle, op13_prefix_trie)}

ORACLE = {
    "op6_line_dedup": """
        WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM parts, unnest(range(1, len(ls) + 1)) AS u(i)),
        firsts AS (
            SELECT line, length(line) AS size, min({'d': doc_id, 'p': pos}) AS id
            FROM lines WHERE line <> '' GROUP BY line),
        near AS (
            SELECT DISTINCT b.id FROM firsts a JOIN firsts b
                ON a.size >= 32 AND b.size >= 32 AND b.size - a.size BETWEEN -1 AND 1 AND a.id < b.id
                AND (left(a.line, 12) = left(b.line, 12) OR right(a.line, 12) = right(b.line, 12))
            WHERE levenshtein(a.line, b.line) <= 1),
        marked AS (
            SELECT l.doc_id, l.pos, l.line, l.line = '' AS short, f.id IS NOT NULL AND n.id IS NULL AS is_first, n.id IS NOT NULL AS is_near
            FROM lines l LEFT JOIN firsts f ON f.id = {'d': l.doc_id, 'p': l.pos} LEFT JOIN near n ON n.id = f.id)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT (short OR is_first)) AS n_removed, count(*) FILTER (is_near) AS n_near,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (short OR is_first), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op3_url_filter": """
        WITH cut AS (
            SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
        parsed AS (
            SELECT page_id,
                translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(rule, rhost, rpath, verdict) AS (VALUES
            ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
            ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
            ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        fits AS (
            SELECT p.*, r.rule, r.verdict,
                row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule) DESC NULLS LAST) AS k
            FROM parsed p LEFT JOIN rules r
                ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
    """,
    "op12_fill_middle": r"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        drawn AS (
            SELECT *, len(u) AS n, [('0x' || s[1:8])::BIGINT, ('0x' || s[9:16])::BIGINT, ('0x' || s[17:24])::BIGINT, ('0x' || s[25:32])::BIGINT] AS h FROM cut),
        placed AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                    WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        parts AS (
            SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS x FROM placed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM parts
    """,
    "op13_prefix_trie": r"""
        WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
        bits AS (
            SELECT c, i, if(i % 8 = 0, ascii(substr(c::VARCHAR, i // 8 + 1, 1)), 0)::BIGINT AS x
            FROM ids, unnest(range(8 * length(c::VARCHAR))) AS r(i)),
        crc AS (
            SELECT c, 0::BIGINT AS i, 4294967295::BIGINT AS v FROM ids
            UNION ALL
            SELECT r.c, r.i + 1, xor(xor(r.v, b.x) >> 1, 3988292384 * (xor(r.v, b.x) & 1)) FROM crc r JOIN bits b ON b.c = r.c AND b.i = r.i),
        drawn AS (SELECT c, xor(max_by(v, i), 4294967295) % 4 AS h FROM crc GROUP BY c),
        own AS (
            SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        whole AS (
            SELECT o.c, list_concat(coalesce(b.ts, [])[1:h], o.ts[h + 1:]) AS ts
            FROM own o JOIN drawn USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 20),
        member AS (SELECT c, d, ts[1:d] AS seq, len(ts) AS total FROM whole, unnest(range(len(ts) + 1)) AS r(d)),
        node AS (
            SELECT seq, any_value(d) AS d, min(c) AS c, count(*) AS n_convs,
                coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (total = d), '') AS ends
            FROM member GROUP BY seq),
        rep AS (SELECT m.c AS mc, m.d, n.c FROM member m JOIN node n ON n.seq = m.seq),
        kids AS (
            SELECT r.c, n.d - 1 AS d, count(*) AS n_children FROM node n JOIN rep r ON r.mc = n.c AND r.d = n.d - 1 GROUP BY ALL),
        worth AS (
            SELECT n.c, n.d, coalesce(k.n_children, 0) AS n_children,
                (n.n_convs - 1) * coalesce(len(regexp_extract_all(n.seq[n.d].t, '[^\x20\x09-\x0D]+')), 0) AS saved
            FROM node n LEFT JOIN kids k ON k.c = n.c AND k.d = n.d),
        sums AS (
            SELECT r.c, r.d, count(*) FILTER (w.n_children = 0) AS n_leaves, sum(w.saved)::BIGINT AS saved_tokens
            FROM worth w JOIN rep r ON r.mc = w.c AND r.d <= w.d GROUP BY ALL)
        SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
        FROM node n JOIN worth w ON w.c = n.c AND w.d = n.d JOIN sums s ON s.c = n.c AND s.d = n.d
            LEFT JOIN rep p ON p.mc = n.c AND p.d = n.d - 1
    """,
}
