"""Queries over the full-text index, hybrid retrieval and imported archives, and the SQL that scans all texts instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkact.functions import blobs, phrases
from sparkact.operators import budgets, hybrid, inverted, lineage, maintenance
from sparkact.operators.rounds import Rounds
from sparkact import report_queries  # noqa: F401  its SQL is part of one below
from sparkact.queries import ACTS, COVERED, HOURS, ORACLE, longs, query
from sparkact.sources.chat_archive import read_archive, write_archive
from sparkact.sources.shared import new_path
from sparkact.sources.tables import activities, messages, read

ASKED = "The THEN; with"
EACH = 5
_built: dict[tuple[str, str], inverted.Index] = {}


def indexed(spark: SparkSession, d: str) -> inverted.Index:
    """The index of the documents, built once for an application and folder."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _built:
        _built[at] = inverted.build(read(spark, d, "documents"))
    return _built[at]


GRAMS = "list_transform(regexp_extract_all(coalesce(text, ''), '[㐀-䶿一-鿿豈-﫿]+'), lambda r: list_transform(range(1, length(r) - {0} + 2), lambda i: substr(r, i, {0})))"
ALL_TERMS = f"""list_concat(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x)),
    flatten({GRAMS.format(2)}), flatten({GRAMS.format(3)}))"""
SCAN = f"""WITH docs AS (SELECT doc_id, {ALL_TERMS} AS w FROM documents WHERE doc_id IS NOT NULL),
    posting AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM docs) GROUP BY doc_id, term),
    totals AS (SELECT count(*) AS n, sum(len(w)) AS size FROM docs),
    freq AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
    idf AS (SELECT term, CASE WHEN df + 0.5 < n - df + 0.5 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, size / n AS mean FROM freq, totals),
    weight AS (SELECT doc_id, term, idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS weight FROM posting JOIN idf USING (term))"""
NAMES = "('the', 'then', 'with')"


@query(f"{SCAN} SELECT DISTINCT doc_id FROM posting WHERE term IN {NAMES}")
def index_any(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).any_of(ASKED).select(F.col("key").alias("doc_id"))


@query(f"{SCAN} SELECT doc_id FROM posting WHERE term IN {NAMES} GROUP BY doc_id HAVING count(*) = 3")
def index_all(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).all_of(ASKED).select(F.col("key").alias("doc_id"))


@query(f"{SCAN} SELECT doc_id, round(sum(weight), 6) AS score FROM weight WHERE term IN {NAMES} GROUP BY doc_id")
def index_bm25(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).scored(ASKED).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""{SCAN}, asked AS (SELECT DISTINCT item_id, unnest({ALL_TERMS}) AS term FROM benchmark),
    scored AS (SELECT item_id, doc_id, round(sum(weight), 6) AS score, count(*) AS hits FROM asked JOIN weight USING (term) GROUP BY item_id, doc_id)
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {EACH}""")
def index_bm25_each(spark: SparkSession, d: str) -> DataFrame:
    """The documents that say most of what each benchmark item says."""
    best = indexed(spark, d).best_each(read(spark, d, "benchmark"), EACH, query_key="item_id", digits=6)
    return longs(best.select(F.col("query_id").alias("item_id"), F.col("key").alias("doc_id"), "score", "hits", "rank"), "rank")


# Documents that have a vector are chunks, their sources conversations; every twentieth asks with its vector and first
# two words, and may see its own source and a third of the others. Toxic documents are denied, poor ones are meanwhile.
CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, source AS conversation, text AS content, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
    requests AS (SELECT chunk_id AS query_id, conversation AS bound, embedding AS q, array_to_string(string_split(content, ' ')[1:2], ' ') AS text FROM chunks WHERE chunk_id % 20 = 0),
    scopes AS (SELECT query_id, c.conversation FROM requests, (SELECT DISTINCT conversation FROM chunks) c WHERE c.conversation = bound OR CAST(substr(c.conversation, 4) AS BIGINT) % 3 = query_id // 20 % 3),
    allowed AS (SELECT * FROM chunks WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""
TOP_K, BUDGET = 8, 20_000
CANDIDATES = hybrid.candidates_for(TOP_K)
HYBRID = f"""{SCAN.replace('doc_id, list_concat', 'chunk_id AS doc_id, list_concat').replace('FROM documents WHERE doc_id IS NOT NULL', 'FROM (SELECT chunk_id, content AS text FROM chunks)').replace('WITH docs', f'WITH {CHUNKS}, docs')},
    asked AS (SELECT DISTINCT query_id, unnest({ALL_TERMS}) AS term FROM requests), needed AS (SELECT query_id, count(*) AS needed FROM asked GROUP BY ALL),
    worded AS (SELECT query_id, doc_id AS chunk_id, sum(weight) AS score FROM asked JOIN weight USING (term) JOIN needed USING (query_id) GROUP BY query_id, doc_id, needed HAVING count(*) = needed),
    words AS (SELECT w.query_id, chunk_id, row_number() OVER (PARTITION BY w.query_id ORDER BY round(w.score, 9) DESC, chunk_id) - 1 AS rank FROM worded w JOIN allowed USING (chunk_id) JOIN scopes s ON s.query_id = w.query_id AND s.conversation = allowed.conversation QUALIFY rank < {CANDIDATES}),
    pairs AS (SELECT query_id, chunk_id, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS score FROM requests JOIN scopes USING (query_id) JOIN allowed USING (conversation)),
    vectors AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM pairs WHERE score >= {hybrid.LEAST_COSINE} QUALIFY rank < {CANDIDATES}),
    fused AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank + 1)) AS score FROM (FROM words UNION ALL FROM vectors) GROUP BY ALL),
    boosted AS (SELECT f.query_id, f.chunk_id, a.conversation, a.content, f.score + CASE WHEN a.conversation = r.bound THEN {hybrid.SAME_CONVERSATION} ELSE 0 END AS score FROM fused f JOIN allowed a USING (chunk_id) JOIN requests r USING (query_id)),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM boosted QUALIFY rank <= {TOP_K}),
    hits AS (SELECT query_id, rank, chunk_id, conversation, score, strlen(content) AS tokens, sum(strlen(content)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used FROM top WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"""


@query(f"{HYBRID} SELECT query_id, rank, chunk_id, conversation, round(score, 9) AS score, tokens, used FROM hits WHERE used <= {BUDGET}")
def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels").withColumnRenamed("doc_id", "chunk_id")
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("conversation"), F.col("text").alias("content")).join(vectors, "chunk_id")
    requests = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("conversation").alias("bound"), F.col("vector").alias("q"), F.substring_index("content", " ", 2).alias("text"))
    number = F.substring("conversation", 4, 9).cast("long")
    places = chunks.select("conversation").distinct().withColumn("third", number % 3)
    third = F.floor(F.col("query_id") / 20) % 3
    scopes = requests.select("query_id", third.alias("third")).join(places, "third").select("query_id", "conversation").unionByName(requests.select("query_id", F.col("bound").alias("conversation")))
    at = (spark.sparkContext.applicationId, f"{d}#chunks")
    if at not in _built:
        _built[at] = inverted.build(chunks, "chunk_id", "content")
    hits = hybrid.retrieved(_built[at], chunks, requests, scopes, labels.where("toxic = 1"), labels.where("quality = 0"), TOP_K, BUDGET)
    return hits.drop("content").withColumn("score", F.round("score", 9))


@query("""SELECT 'e1' AS export_id, conv_id::VARCHAR AS conversation, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS source_ordinal, role AS sender, turn * 60000 AS created_at_ms, text AS content FROM conversations""")
def archive_import(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as chat archives and imported again, each by a task of its own."""
    path = new_path(spark, "archive")
    write_archive(messages(spark, d), path, "e1", "a1")
    return read_archive(spark, path).select("export_id", "conversation", "source_ordinal", "sender", "created_at_ms", "content")


@query("""WITH d AS (SELECT *, strlen(coalesce(text, '')) AS size FROM documents WHERE n_chars >= 100), u AS (SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id DESC)::BIGINT AS used FROM d) SELECT * FROM u WHERE used <= 1500000""")
def size_retention(spark: SparkSession, d: str) -> DataFrame:
    """Oldest documents go first (the smallest ids) until the rest fits; short ones have expired."""
    docs = read(spark, d, "documents").withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return budgets.retained(docs, [-F.col("doc_id")], "size", 1_500_000, F.col("n_chars") >= 100).select("doc_id", "size", "used")


@query("""WITH u AS (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM conversations) SELECT * FROM u WHERE used <= 1200""")
def running_budget(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").alias("size"))
    return budgets.within(turns, ["conv_id"], ["turn"], "size", 1200).select("conv_id", "turn", "used")


@query("""SELECT vec_id, 4 * len(embedding) AS bytes, len(embedding) AS n, true AS same, len(embedding) = 64 AS exact FROM embeddings""")
def vector_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as bytes, with a tail that is cut off again."""
    e = read(spark, d, "embeddings").withColumn("blob", blobs.encoded(F.col("embedding")))
    e = e.withColumn("again", blobs.decoded(F.concat("blob", F.lit(b"abc")))).withColumn("exactly", blobs.decoded_exactly(F.col("blob"), 64))
    return e.select("vec_id", F.octet_length("blob").cast("long").alias("bytes"), F.size("again").cast("long").alias("n"), (F.col("again") == F.col("embedding")).alias("same"), F.coalesce(F.col("exactly") == F.col("embedding"), F.lit(False)).alias("exact"))


QUESTIONS = ["今天做了什么", "昨日 和 前天", "最近12天 的代码", "近 3 天还是过去40天", "最近怎么样", "最近 5 天", "本周", "上一周与本月", "上个月", "no phrase", "这个月 今日", "上周末", None]
WORDS = ["today", "昨天", "前天", "这周", "上周", "2024-01-05", None, "Yesterday"]
ZONE = "Asia/Shanghai"


def phrase_rows() -> str:
    """SQL of phrase(word, span)."""
    return "VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in phrases.SPANS.items())


ASKED_SQL = f"""asked AS (SELECT event_id, {[q or '' for q in QUESTIONS]}[event_id % {len(QUESTIONS)} + 1] AS q, {[w or 'today' for w in WORDS]}[event_id % {len(WORDS)} + 1] AS w, (ts + INTERVAL 8 HOUR)::DATE AS today FROM events)"""


@query(rf"""WITH {ASKED_SQL}, phrase(word, span) AS ({phrase_rows()}),
    base AS (SELECT *, date_trunc('week', today)::DATE AS week, date_trunc('month', today)::DATE AS month FROM asked),
    found AS (SELECT event_id, CASE span WHEN 'today' THEN today WHEN 'yesterday' THEN today - 1 WHEN 'day before' THEN today - 2 WHEN 'week' THEN week WHEN 'last week' THEN week - 7 WHEN 'month' THEN month ELSE (month - INTERVAL 1 MONTH)::DATE END AS s,
            CASE span WHEN 'yesterday' THEN today - 1 WHEN 'day before' THEN today - 2 WHEN 'last week' THEN week - 1 WHEN 'last month' THEN month - 1 ELSE today END AS e FROM base JOIN phrase ON contains(q, word)
        UNION ALL SELECT event_id, today - unnest(regexp_extract_all(q, '(?:最近|近|过去)\s*(\d+)\s*天', 1))::INTEGER, today FROM base
        UNION ALL SELECT event_id, today - 7, today FROM base WHERE contains(q, '最近') AND NOT regexp_matches(q, '最近\s*\d+\s*天'))
    SELECT event_id, min(s)::VARCHAR AS start, max(e)::VARCHAR AS stop,
        CASE any_value(lower(w)) WHEN 'today' THEN any_value(today)::VARCHAR WHEN 'yesterday' THEN (any_value(today) - 1)::VARCHAR WHEN '昨天' THEN (any_value(today) - 1)::VARCHAR WHEN '前天' THEN (any_value(today) - 2)::VARCHAR
            WHEN '这周' THEN any_value(week)::VARCHAR WHEN '上周' THEN (any_value(week) - 7)::VARCHAR ELSE any_value(lower(w)) END AS day
    FROM base LEFT JOIN found USING (event_id) GROUP BY event_id""")
def time_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Questions put at the events' times, in a zone eight hours ahead."""
    at = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("event_id") % len(items) + 1).cast("int"))
    e = read(spark, d, "events").select("event_id", at(QUESTIONS).alias("q"), at(WORDS).alias("w"), phrases.local_day(F.col("ts").cast("timestamp"), ZONE).alias("today"))
    found = phrases.range_of(F.col("q"), F.col("today"))
    return e.select("event_id", found["start"].cast("string").alias("start"), found["end"].cast("string").alias("stop"), phrases.single_day(F.col("w"), F.col("today")).alias("day"))


@query("""SELECT doc_id, CASE WHEN doc_id % 50 = 9 THEN 'removed' WHEN doc_id % 50 = 7 THEN 'changed' END AS change, CASE WHEN doc_id % 50 = 7 THEN 'second' END AS source FROM documents WHERE doc_id % 50 IN (7, 9)
    UNION ALL SELECT -1 - doc_id, 'added', 'second' FROM documents WHERE doc_id % 50 = 11""")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """A second import of the documents, of which some are changed, gone or new, against the first; with their sources."""
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    later = docs.where("doc_id % 50 <> 9").withColumn("text", F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    later = later.unionByName(docs.where("doc_id % 50 = 11").withColumn("doc_id", -1 - F.col("doc_id")))
    first, second = lineage.saved(docs, ["doc_id"], buckets=32), lineage.saved(later, ["doc_id"], buckets=32)
    edges = lineage.edges(second, "second", first, lineage.edges(first, "first"))
    return first.changes(second).join(edges, "doc_id", "left").select("doc_id", "change", "source")


# Of the events, every eleventh is deleted, every thirteenth comes later, and of each seventh the category changes.
CHANGED = f"""WITH {ACTS.replace('acts AS', 'all_acts AS')}, acts AS (SELECT * REPLACE (CASE WHEN id % 7 = 2 THEN 'own' ELSE category END AS category) FROM all_acts WHERE id % 11 <> 3)"""


def before_and_changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records before, changes, records after)."""
    every = activities(spark, d)
    before = every.where("id % 13 <> 5")
    moved = before.where("id % 7 = 2 AND id % 11 <> 3")
    as_own = lambda x: x.withColumn("category", F.when(F.col("id") % 7 == 2, "own").otherwise(F.col("category")))
    gone, came = before.where("id % 11 = 3"), as_own(every.where("id % 13 = 5 AND id % 11 <> 3"))
    signed = maintenance.changes(came, gone).unionByName(maintenance.reclassified(moved, as_own(moved)))
    return before, signed, as_own(every.where("id % 11 <> 3"))


@query(f"{CHANGED} SELECT owner, CAST(floor(end_ts / 86400) AS BIGINT) AS day, app, category, count(*) AS n, sum(duration)::BIGINT AS seconds FROM acts GROUP BY ALL")
def usage_after_changes(spark: SparkSession, d: str) -> DataFrame:
    before, signed, _ = before_and_changes(spark, d)
    return maintenance.updated_usage(maintenance.usage(maintenance.changes(before)), signed)


@query(f"{CHANGED}, {HOURS}, {COVERED} SELECT owner, hour, seconds FROM covered")
def covered_after_changes(spark: SparkSession, d: str) -> DataFrame:
    before, signed, after = before_and_changes(spark, d)
    return maintenance.updated_covered(maintenance.covered_hours(before), after, signed)


@query(f"SELECT date, app, place, content, last_id FROM ({ORACLE['memory_chunks']})")
def index_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the events, indexed in three rounds."""
    acts = activities(spark, d)
    rounds, third = Rounds(spark, new_path(spark, "rounds")), acts.count() // 3 + 1
    while rounds.round(acts, F.concat(F.lit("t"), F.col("id") % 9), F.concat("app", F.expr("repeat('.', cast(duration % 11 AS int))")), third):
        pass
    return rounds.table().select("date", "app", "place", "content", "last_id")
