"""Named queries over the tables of a directory, and for each one DuckDB SQL with equal rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkact.functions import text as tx
from sparkact.functions import vectors as vec
from sparkact.functions.intervals import clipped
from sparkact.operators import activity as act
from sparkact.operators import messages as msg
from sparkact.operators import retrieval as ret
from sparkact.sources.archive import timeline_documents
from sparkact.sources.tables import activities, messages, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DAY0 = 19723  # 2024-01-01
LO, HI = DAY0 * 86400 + 5 * 86400, DAY0 * 86400 + 10 * 86400
TERMS = ["the", "then", "with"]

ACTS = """acts AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS end_ts, event_type AS app, user_id AS owner,
    CAST(floor(value) AS BIGINT) AS duration,
    CASE WHEN event_type IN ('view', 'click') THEN 'https://site' || (user_id % 7) || '.example.org/' || event_type || '/' END AS url,
    CASE event_type WHEN 'error' THEN 'development' WHEN 'view' THEN 'browser' WHEN 'click' THEN 'browser' WHEN 'signup' THEN 'communication' WHEN 'purchase' THEN 'entertainment' ELSE 'other' END AS category,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(value) AS BIGINT) AS start_ts FROM events)"""
SPLIT = """{0}s AS (SELECT a.*, h AS {0}, greatest(a.start_ts, h * {1}) AS s, least(a.end_ts, (h + 1) * {1}) AS e
    FROM acts a, unnest(range(CAST(floor(a.start_ts / {1}) AS BIGINT), CAST(floor((a.end_ts - 1) / {1}) AS BIGINT) + 1)) AS u(h) WHERE a.end_ts > a.start_ts)"""
DAYS, HOURS = SPLIT.format("day", 86400), SPLIT.format("hour", 3600)
COVERED = """covered AS (SELECT owner, hour, sum(greatest(e - greatest(s, coalesce(pe, s)), 0))::BIGINT AS seconds FROM (
    SELECT *, max(e) OVER (PARTITION BY owner, hour ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM hours) GROUP BY ALL)"""
SESSIONS = """marked AS (SELECT *, greatest(duration, 1) AS length, CASE WHEN end_ts - greatest(duration, 1) - lag(end_ts) OVER w <= 900 THEN 0 ELSE 1 END AS fresh
        FROM acts WINDOW w AS (PARTITION BY owner ORDER BY end_ts, id)),
    sess AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY owner ORDER BY end_ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked),
    stable AS (SELECT owner, session, min_by(end_ts - length, (end_ts, id)) AS start_ts, max(end_ts) AS end_ts, sum(length)::BIGINT AS seconds, count(*) AS n, count(DISTINCT app) AS apps FROM sess GROUP BY ALL)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


TIMELINE = f"""WITH {ACTS}, cut AS (SELECT *, greatest(start_ts, {LO}) AS s, least(end_ts, {HI}) AS e, coalesce(rtrim(url, '/'), '') AS page FROM acts WHERE end_ts > {LO} AND start_ts < {HI}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY owner, app, page ORDER BY end_ts DESC, id DESC) AS rn, sum(e - s) OVER (PARTITION BY owner, app, page)::BIGINT AS seconds FROM cut)
    SELECT id, end_ts, owner, app, page, seconds FROM ranked WHERE rn = 1"""


@query(TIMELINE)
def timeline(spark, d):
    return act.timeline(activities(spark, d, since=LO + 1), LO, HI)


@query(TIMELINE + " ORDER BY end_ts DESC, id DESC LIMIT 20 OFFSET 10")
def timeline_page(spark, d):
    return act.page(act.timeline(activities(spark, d, since=LO + 1), LO, HI), [F.desc("end_ts"), F.desc("id")], 10, 20)


@query(f"WITH {ACTS} SELECT id, end_ts, app FROM acts WHERE (end_ts, id) > ({LO}, 0) ORDER BY end_ts, id LIMIT 50")
def keyset_page(spark, d):
    return act.after(activities(spark, d, since=LO), (LO, 0), 50).select("id", "end_ts", "app")


@query(f"WITH {ACTS} SELECT id, end_ts, app, duration FROM acts WHERE end_ts >= {LO} AND end_ts < {HI} ORDER BY end_ts, id LIMIT 1000")
def range_scan(spark, d):
    return activities(spark, d, LO, HI).orderBy("end_ts", "id").limit(1000).select("id", "end_ts", "app", "duration")


@query(f"WITH {ACTS} SELECT * FROM acts WHERE id = 42")
def point_lookup(spark, d):
    return activities(spark, d).where("id = 42")


@query(f"WITH {ACTS} SELECT id, greatest(start_ts, {LO}) AS s, least(end_ts, {LO} + 86400) AS e FROM acts WHERE end_ts > {LO} AND start_ts < {LO} + 86400")
def clip_day(spark, d):
    return clipped(activities(spark, d, since=LO + 1), LO, LO + 86400).select("id", "s", "e")


@query(f"WITH {ACTS}, {DAYS} SELECT day, sum(e - s)::BIGINT AS seconds, count(DISTINCT owner) AS owners FROM days GROUP BY day")
def day_totals(spark, d):
    return act.day_totals(activities(spark, d))


@query(f"WITH {ACTS}, {HOURS}, {COVERED} SELECT owner, hour, seconds FROM covered")
def hourly_covered(spark, d):
    return act.hourly_covered(activities(spark, d))


@query(f"WITH {ACTS}, {HOURS}, {COVERED}, h24 AS (SELECT hour % 24 AS h, sum(seconds)::BIGINT AS seconds FROM covered GROUP BY ALL) SELECT r.range AS h, coalesce(seconds, 0) AS seconds FROM range(24) r LEFT JOIN h24 ON h24.h = r.range")
def hour_of_day(spark, d):
    return act.hour_of_day(activities(spark, d))


@query(f"WITH {ACTS}, {HOURS}, {COVERED}, h24 AS (SELECT hour % 24 AS h, sum(seconds)::BIGINT AS seconds FROM covered GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY seconds DESC, h) AS rank FROM h24 QUALIFY rank <= 3")
def peak_hours(spark, d):
    return longs(act.peak_hours(activities(spark, d)), "rank")


@query(f"""WITH {ACTS}, {HOURS}, pts AS (SELECT DISTINCT owner, hour, unnest([s, e]) AS a FROM hours),
    atoms AS (SELECT *, lead(a) OVER (PARTITION BY owner, hour ORDER BY a) AS b FROM pts),
    won AS (SELECT t.owner, t.hour, t.a, t.b, arg_max(h.app, (h.end_ts, h.id)) AS app FROM atoms t JOIN hours h ON h.owner = t.owner AND h.hour = t.hour AND h.s <= t.a AND h.e >= t.b WHERE t.b IS NOT NULL GROUP BY ALL)
    SELECT owner, hour, app, sum(b - a)::BIGINT AS seconds FROM won GROUP BY ALL""")
def hour_app_attribution(spark, d):
    return act.hour_app_attribution(activities(spark, d))


def usage_sql(key: str) -> str:
    return f"WITH {ACTS}, u AS (SELECT {key}, sum(duration)::BIGINT AS seconds, count(*) AS n FROM acts GROUP BY ALL) SELECT *, CAST(floor(seconds * 100 / greatest(sum(seconds) OVER (), 1)) AS BIGINT) AS percent FROM u"


@query(usage_sql("app"))
def app_usage(spark, d):
    return act.usage(activities(spark, d), "app")


@query(usage_sql("category"))
def category_usage(spark, d):
    return act.usage(activities(spark, d), "category")


@query(f"WITH {ACTS} SELECT regexp_extract(url, '^https://([^/]*)', 1) AS domain, sum(duration)::BIGINT AS seconds, count(DISTINCT url) AS pages FROM acts WHERE url IS NOT NULL GROUP BY ALL")
def domain_usage(spark, d):
    return act.domain_usage(activities(spark, d))


@query(f"WITH {ACTS} SELECT app AS browser, regexp_extract(url, '^https://([^/]*)', 1) AS domain, rtrim(url, '/') AS page, sum(duration)::BIGINT AS seconds FROM acts WHERE url IS NOT NULL GROUP BY ROLLUP (browser, domain, page)")
def browser_rollup(spark, d):
    return act.browser_rollup(activities(spark, d))


@query(f"WITH {ACTS}, w AS (SELECT owner, category AS label, sum(duration)::BIGINT AS w FROM acts GROUP BY ALL) SELECT owner, label AS mode, w AS weight FROM w QUALIFY row_number() OVER (PARTITION BY owner ORDER BY w DESC, label) = 1")
def weighted_mode(spark, d):
    return act.weighted_mode(activities(spark, d), ["owner"], "category", "duration")


@query(f"""WITH {ACTS}, {DAYS}, seg(a, b) AS (VALUES (32400, 43200), (39600, 64800), (79200, 86400), (0, 3600)),
    inside AS (SELECT owner, day, greatest(s, day * 86400 + a) AS s, least(e, day * 86400 + b) AS e FROM days, seg),
    pre AS (SELECT *, max(e) OVER (PARTITION BY owner, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM inside WHERE e > s)
    SELECT owner, day, sum(greatest(e - greatest(s, coalesce(pe, s)), 0))::BIGINT AS work_seconds FROM pre GROUP BY ALL""")
def work_time(spark, d):
    return act.work_time(activities(spark, d), [(32400, 43200), (39600, 64800), (79200, 3600)])


@query(f"WITH {ACTS}, {DAYS} SELECT day, sum(greatest(least(e, day * 86400 + 86400) - greatest(s, day * 86400 + 64800), 0))::BIGINT AS overtime_seconds FROM days GROUP BY day")
def overtime(spark, d):
    return act.overtime(activities(spark, d), 64800)


@query(f"WITH {ACTS}, {DAYS} SELECT CAST(floor((day + 3) / 7) AS BIGINT) AS week, category, sum(e - s)::BIGINT AS seconds, count(DISTINCT day) AS active_days FROM days GROUP BY ALL")
def week_merge(spark, d):
    return act.weeks(activities(spark, d))


@query(f"""WITH {ACTS}, t AS (SELECT category, sum(greatest(least(end_ts, {LO}) - greatest(start_ts, {LO - 432000}), 0))::BIGINT AS old, sum(greatest(least(end_ts, {HI}) - greatest(start_ts, {LO}), 0))::BIGINT AS new FROM acts GROUP BY ALL)
    SELECT category, old, new, new - old AS delta, CASE WHEN old > 0 THEN round((new - old) * 100.0 / old, 4) END AS percent, CASE WHEN old = 0 THEN 'new' WHEN new = 0 THEN 'gone' ELSE 'both' END AS state FROM t WHERE old + new > 0""")
def trend_compare(spark, d):
    return act.trend(activities(spark, d), "category", (LO - 432000, LO), (LO, HI))


@query(f"WITH {ACTS} SELECT owner, app, max(end_ts) AS end_ts, arg_max(id, (end_ts, id)) AS id, arg_max(category, (end_ts, id)) AS category, arg_max(url, (end_ts, id)) AS url FROM acts GROUP BY ALL")
def recent_latest(spark, d):
    return act.latest(activities(spark, d), ["owner", "app"])


@query(f"WITH {ACTS} SELECT owner, app, sum(duration)::BIGINT AS seconds FROM acts GROUP BY ALL HAVING seconds >= 600 ORDER BY seconds DESC, owner, app LIMIT 50")
def unclassified_having(spark, d):
    return act.heavy(activities(spark, d), ["owner", "app"], 600, 50)


@query(f"WITH {ACTS}, {SESSIONS} SELECT * FROM stable")
def sessions(spark, d):
    return act.session_table(activities(spark, d))


@query(f"WITH {ACTS}, {SESSIONS}, t AS (SELECT owner, session, app, sum(length)::BIGINT AS seconds FROM sess GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY owner, session ORDER BY seconds DESC, app) AS rank FROM t QUALIFY rank <= 2")
def session_top(spark, d):
    return longs(act.session_top(activities(spark, d)), "rank")


@query(f"""WITH {ACTS}, {SESSIONS}, lab AS (SELECT *, CASE WHEN app = 'error' THEN 'development' WHEN app = 'purchase' THEN 'shopping' WHEN app = 'signup' THEN 'onboarding' WHEN app IN ('view', 'click') THEN 'browsing' ELSE 'other' END AS intent FROM sess),
    pts AS (SELECT owner, session, intent, count(*) * 10 AS points FROM lab GROUP BY ALL), best AS (SELECT owner, session, intent FROM pts QUALIFY row_number() OVER (PARTITION BY owner, session ORDER BY points DESC, intent) = 1)
    SELECT intent, count(*) AS sessions, sum(seconds)::BIGINT AS seconds FROM best JOIN stable USING (owner, session) GROUP BY ALL""")
def intent_summary(spark, d):
    return act.intents(activities(spark, d))


@query(f"""WITH {ACTS}, {SESSIONS}, t AS (SELECT *, CAST(floor(start_ts / 86400) AS BIGINT) AS day FROM stable),
    byday AS (SELECT CAST(floor((day + 3) / 7) AS BIGINT) AS week, day, sum(seconds)::BIGINT AS s, count(*) AS n, count(*) FILTER (seconds >= 300) AS deep, count(*) FILTER (apps >= 2) AS switching FROM t GROUP BY ALL)
    SELECT week, sum(n)::BIGINT AS sessions, sum(deep)::BIGINT AS deep, sum(switching)::BIGINT AS switching, count(*) AS active_days, arg_max(day, (s, -day)) AS busiest_day, max(s) AS busiest_seconds FROM byday GROUP BY week""")
def weekly_kpis(spark, d):
    return act.weekly_review(activities(spark, d))


@query(f"""WITH {ACTS}, {HOURS}, {COVERED}, a AS (SELECT owner, hour, CAST(floor(hour / 24) AS BIGINT) AS day, hour - row_number() OVER (PARTITION BY owner, CAST(floor(hour / 24) AS BIGINT) ORDER BY hour) AS isl FROM covered WHERE seconds >= 1),
    r AS (SELECT owner, day, isl, count(*) AS length, min(hour) AS first FROM a GROUP BY ALL)
    SELECT owner, day, length, first AS first_hour FROM r QUALIFY row_number() OVER (PARTITION BY owner, day ORDER BY length DESC, first) = 1""")
def active_runs(spark, d):
    return act.active_runs(activities(spark, d))


@query(f"""WITH {ACTS}, r AS (SELECT *, CAST(floor(end_ts / 3600) AS BIGINT) AS hour FROM acts), c AS (SELECT *, lag(app) OVER (PARTITION BY owner, hour ORDER BY end_ts, id) AS pa FROM r),
    u AS (SELECT owner, hour, url, min((end_ts, id)) AS seen FROM r WHERE url IS NOT NULL GROUP BY ALL), p AS (SELECT owner, hour, array_to_string(list_slice(list(url ORDER BY seen), 1, 5), '|') AS pages FROM u GROUP BY ALL)
    SELECT c.owner, c.hour, count(*) AS n, sum(duration)::BIGINT AS seconds, count(*) FILTER (pa <> app) AS changes, coalesce(any_value(pages), '') AS pages FROM c LEFT JOIN p ON p.owner = c.owner AND p.hour = c.hour GROUP BY c.owner, c.hour""")
def hour_stats(spark, d):
    return act.hour_stats(activities(spark, d))


@query(f"""WITH {ACTS}, {DAYS}, t AS (SELECT day, category, sum(e - s)::BIGINT AS seconds FROM days GROUP BY ALL)
    SELECT day, category, seconds, round(seconds / sum(seconds) OVER (PARTITION BY day), 6) AS share FROM t QUALIFY category <> 'development' AND seconds / sum(seconds) OVER (PARTITION BY day) > 0.25""")
def insights(spark, d):
    return act.insights(activities(spark, d))


@query(f"""WITH {ACTS}, m AS (SELECT *, CASE WHEN lag(app) OVER w IS NULL OR lag(app) OVER w <> app OR end_ts - lag(end_ts) OVER w > 600 THEN 1 ELSE 0 END AS fresh FROM acts WINDOW w AS (PARTITION BY owner ORDER BY end_ts, id)),
    r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY owner ORDER BY end_ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m) SELECT owner, run, app, sum(duration)::BIGINT AS seconds, max(end_ts) AS end_ts, count(*) AS n FROM r GROUP BY ALL""")
def capture_merge(spark, d):
    return act.merged_captures(activities(spark, d))


@query(f"WITH {ACTS} SELECT id, owner, end_ts FROM acts QUALIFY row_number() OVER (PARTITION BY owner ORDER BY end_ts DESC, id DESC) <= 3")
def retention(spark, d):
    return act.retained(activities(spark, d), 3).select("id", "owner", "end_ts")


@query(f"WITH {ACTS} SELECT app, count(*) AS n, count(url) AS with_url, count(DISTINCT owner) AS owners, coalesce(max(k), 0) AS most, min(end_ts) AS first, max(end_ts) AS last FROM acts GROUP BY app")
def counts_by_app(spark, d):
    return activities(spark, d).groupBy("app").agg(F.count("*").alias("n"), F.count("url").alias("with_url"), F.count_distinct("owner").alias("owners"), F.coalesce(F.max("k"), F.lit(0)).alias("most"), F.min("end_ts").alias("first"), F.max("end_ts").alias("last"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return activities(spark, d).select(F.col("id").alias("event_id"), "k")


TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 0))"


@query(f"WITH w AS (SELECT doc_id, text, {TOKENS} AS w FROM documents), s AS (SELECT doc_id, {' + '.join(f'''CASE WHEN list_contains(w, '{t}') THEN 45 WHEN contains(lower(text), '{t}') THEN 20 ELSE 0 END''' for t in TERMS)} AS score FROM w) SELECT * FROM s WHERE score > 0")
def keyword_score(spark, d):
    return ret.keyword_scores(read(spark, d, "documents"), TERMS).select("doc_id", "score")


@query(f"WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents) SELECT doc_id FROM w WHERE list_has_any(w, {TERMS!r})")
def fts_or(spark, d):
    return ret.matches_any(read(spark, d, "documents"), TERMS).select("doc_id")


@query(f"WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents) SELECT doc_id FROM w WHERE list_has_all(w, {TERMS!r})")
def fts_and_pretoken(spark, d):
    return ret.matches_all(read(spark, d, "documents"), TERMS).select("doc_id")


BM25 = f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl, {', '.join(f"count(*) FILTER (list_contains(w, '{t}')) AS df{i}" for i, t in enumerate(TERMS))} FROM w),
    scored AS (SELECT doc_id, {' + '.join(f"CASE WHEN list_contains(w, '{t}') THEN ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(w) / avgdl)) ELSE 0.0 END" for i, t in enumerate(TERMS))} AS score FROM w, s WHERE list_has_any(w, {TERMS!r}))"""


@query(BM25 + " SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 25")
def bm25_topk(spark, d):
    return ret.bm25(read(spark, d, "documents"), "doc_id", TERMS).orderBy(F.desc("score"), "doc_id").limit(25).select("doc_id", F.round("score", 6).alias("score"))


KNN = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS score FROM embeddings, q)"""


def knn(spark, d, k=20):
    e = read(spark, d, "embeddings")
    return ret.nearest(e, e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k)


@query(f"WITH {KNN} SELECT vec_id, round(score, 6) AS score FROM v ORDER BY v.score DESC, vec_id LIMIT 20")
def knn_topk(spark, d):
    return knn(spark, d).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(x, x)) AS size FROM e),
    v AS (SELECT q.vec_id AS query_id, n.vec_id, list_dot_product(n.x, q.x) / (q.size * n.size) AS score FROM n, n q WHERE q.vec_id % 20 = 0)
    SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY v.score DESC, vec_id) AS rank FROM v QUALIFY rank <= 20""")
def knn_topk_each(spark, d):
    e = read(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return longs(ret.nearest_each(e, asked, 20).withColumn("score", F.round("score", 6)), "rank")


@query(f"{BM25}, {KNN}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 30), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM v QUALIFY rank <= 30) SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS lists FROM (FROM a UNION ALL FROM b) GROUP BY id")
def rrf_fuse(spark, d):
    a = ret.ranked(ret.bm25(read(spark, d, "documents"), "doc_id", TERMS), [F.desc("score"), F.asc("doc_id")], 30).withColumnRenamed("doc_id", "id")
    b = ret.ranked(knn(spark, d, 30), [F.desc("score"), F.asc("vec_id")], 30).withColumnRenamed("vec_id", "id")
    return ret.fused([a, b], "id").withColumn("score", F.round("score", 9))


@query(f"{BM25}, top AS (SELECT doc_id, score, strlen(text) AS size FROM scored JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50), u AS (SELECT doc_id, size, sum(size) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM top) SELECT * FROM u WHERE used <= 20000")
def token_budget(spark, d):
    docs = read(spark, d, "documents")
    top = ret.bm25(docs, "doc_id", TERMS).orderBy(F.desc("score"), "doc_id").limit(50)
    sized = docs.join(F.broadcast(top), "doc_id").select("doc_id", "score", F.octet_length("text").cast("long").alias("size"))
    return ret.within_budget(sized, "size", [F.desc("score"), F.asc("doc_id")], 20000).select("doc_id", "size", "used")


MSGS = "msgs AS (SELECT conv_id AS conversation, turn AS ordinal, role, text AS content, turn * 60000 AS created_at_ms, CASE WHEN role = 'assistant' THEN 'self' ELSE 'other' END AS direction FROM conversations)"


@query(f"""WITH {MSGS}, sparse AS (SELECT *, ordinal * ordinal * 400000 AS tms FROM msgs), m AS (SELECT *, CASE WHEN tms - lag(tms) OVER w <= 1800000 THEN 0 ELSE 1 END AS fresh FROM sparse WINDOW w AS (PARTITION BY conversation ORDER BY tms, ordinal)),
    c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conversation ORDER BY tms, ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk FROM m) SELECT conversation, chunk, count(*) AS n, min(tms) AS started_ms, max(tms) AS ended_ms, sum(strlen(content))::BIGINT AS bytes FROM c GROUP BY ALL""")
def chunk_gap_split(spark, d):
    m = messages(spark, d).withColumn("created_at_ms", F.col("ordinal") * F.col("ordinal") * 400000)
    return msg.gap_chunks(m, 1_800_000)


@query(None)
def message_chunks(spark, d):
    return msg.chunks(messages(spark, d))


@query(f"WITH {MSGS}, v AS (SELECT conversation, role, sha256(content) AS content_hash, min(created_at_ms) AS first_ms, count(*) AS copies FROM msgs GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY conversation, role ORDER BY first_ms, content_hash) AS version FROM v")
def version_dedup(spark, d):
    return longs(msg.versions(messages(spark, d), ["conversation", "role"]), "version")


@query("SELECT lang, arg_max(doc_id, (n_chars, source, doc_id)) AS doc_id, max(n_chars) AS n_chars, arg_max(source, (n_chars, source, doc_id)) AS source FROM documents GROUP BY lang")
def precedence_winner(spark, d):
    return msg.winners(read(spark, d, "documents"), ["lang"], ["n_chars", "source", "doc_id"], ["n_chars", "source", "doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def denial_anti(spark, d):
    return msg.allowed(read(spark, d, "documents"), read(spark, d, "labels").where("toxic = 1"), ["doc_id"]).select("doc_id", "source")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))")
def provenance_division(spark, d):
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    return msg.with_full_provenance(read(spark, d, "orders").select("o_orderkey"), items, read(spark, d, "supplier").where("s_acctbal > 0"), "o_orderkey", "s_suppkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scope_semi(spark, d):
    scope = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return msg.in_scope(read(spark, d, "orders"), scope, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def orphan_full_outer(spark, d):
    return msg.orphans(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("SELECT 'document' AS kind, doc_id AS id, 200 AS score FROM documents WHERE lang = 'en' UNION ALL SELECT 'page', page_id, 180 FROM pages UNION ALL SELECT 'benchmark', item_id, 160 FROM benchmark")
def union_sources(spark, d):
    a = read(spark, d, "documents").where("lang = 'en'").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(200).alias("score"))
    b = read(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.lit(180).alias("score"))
    c = read(spark, d, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), F.lit(160).alias("score"))
    return a.unionByName(b).unionByName(c)


def redacted_sql(x: str) -> str:
    for pattern, placeholder in tx.PERSONAL:
        x = f"regexp_replace({x}, '{pattern}', '{placeholder}', 'g')"
    return x


@query(f"SELECT doc_id, sha256({redacted_sql('text')}) AS redacted FROM documents")
def pii_redact(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(tx.redacted(F.col("text")), 256).alias("redacted"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\n .,;:!?''()/-]', '', 'g'), '[ ]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 2) AS ls, text FROM documents),
    c AS (SELECT doc_id, text, array_to_string(list_filter(ls, lambda x, i: list_position(list_transform(ls, lambda y: lower(y)), lower(x)) = i), chr(10)) AS c FROM l)
    SELECT doc_id, sha256(c) AS cleaned, length(c) >= 4 AND length(c) / greatest(length(text), 1) >= 0.45 AS good FROM c""")
def ocr_clean(spark, d):
    c = read(spark, d, "documents").select("doc_id", "text", tx.clean_lines(F.col("text")).alias("c"))
    return c.select("doc_id", F.sha2("c", 256).alias("cleaned"), tx.quality_gate(F.col("text"), F.col("c")).alias("good"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g') AS x FROM pages),
    b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM a)
    SELECT page_id, sha256(trim(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'))) AS text_hash FROM b""")
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(tx.html_text(F.col("html")), 256).alias("text_hash"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, len(string_split(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '.')) AS parts FROM pages")
def domain_parts(spark, d):
    h = tx.host(F.col("url"))
    return read(spark, d, "pages").select("page_id", h.alias("host"), F.size(tx.suffixes(h)).cast("long").alias("parts"))


@query("WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages) SELECT page_id, host FROM h WHERE (host <> 'example.com' AND starts_with(host, 'example.com') AND NOT starts_with(host, 'example.com.')) OR ends_with(host, '.example.com')")
def merged_domain(spark, d):
    h = read(spark, d, "pages").select("page_id", tx.host(F.col("url")).alias("host"))
    return h.where(tx.merged_domain(F.col("host"), "example.com"))


@query("WITH s AS (SELECT page_id, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '.'))) AS suffix FROM (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '.') AS p FROM pages)), k(suffix, label) AS (VALUES ('com', 'commercial'), ('example.com', 'sample'), ('org', 'organisation')) SELECT page_id, k.suffix AS suffix, label FROM s JOIN k ON s.suffix = k.suffix QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(k.suffix) DESC) = 1")
def domain_knowledge(spark, d):
    known = spark.createDataFrame([("com", "commercial"), ("example.com", "sample"), ("org", "organisation")], "suffix string, label string")
    hosts = read(spark, d, "pages").select("page_id", F.explode(tx.suffixes(tx.host(F.col("url")))).alias("suffix"))
    hit = hosts.join(F.broadcast(known), "suffix")  # three rows
    return hit.groupBy("page_id").agg(F.max(F.struct(F.length("suffix").alias("n"), "suffix", "label")).alias("b")).select("page_id", "b.suffix", "b.label")


@query("SELECT owner, array_to_string(list_slice(list_sort(list(DISTINCT app)), 1, 3), ',') AS apps FROM (SELECT user_id AS owner, event_type AS app FROM events) GROUP BY owner")
def array_distinct_cap(spark, d):
    return activities(spark, d).groupBy("owner").agg(F.array_join(F.slice(F.array_sort(F.collect_set("app")), 1, 3), ",").alias("apps"))


@query(None)
def sha_key(spark, d):
    return messages(spark, d).select("conversation", "ordinal", tx.prefixed_digest(F.col("role"), F.col("content")).alias("message_key"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, round(CAST(embedding AS DOUBLE[])[1] / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS first FROM embeddings")
def l2_normalise(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(vec.norm(F.col("embedding")), 6).alias("norm"), F.round(F.element_at(vec.unit(F.col("embedding")), 1), 6).alias("first"))


@query("SELECT event_id, CAST(100 - floor(CAST(bit_count(xor(event_id * 2654435761, user_id * 40503)) AS BIGINT) * 100 / 64) AS BIGINT) AS similarity FROM events")
def hamming(spark, d):
    return read(spark, d, "events").select("event_id", vec.hamming_similarity(F.col("event_id") * 2654435761, F.col("user_id") * 40503).alias("similarity"))


@query("WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT * FROM t WHERE rank <= 3")
def top_k_per_group(spark, d):
    return longs(act.top_by_group(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3), "rank")


@query("WITH s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_mktsegment, n, round(n * 100.0 / sum(n) OVER (), 4) AS percent FROM s")
def percent_share(spark, d):
    from pyspark.sql.window import Window

    s = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))  # few segments
    return s.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


@query("WITH old AS (SELECT doc_id, n_chars AS v FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, n_chars + 1 AS v FROM documents WHERE doc_id % 2 = 0) SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(greatest(n.v, o.v), n.v, o.v) AS v FROM old o FULL JOIN new n ON o.doc_id = n.doc_id")
def upsert(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("v"))
    return msg.latest_wins(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 2 = 0").withColumn("v", F.col("v") + 1), ["doc_id"], "v")


@query("WITH old AS (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, 'new' AS lang FROM documents WHERE doc_id % 2 = 0) SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def carry_over(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang")
    return msg.carried_over(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 2 = 0").withColumn("lang", F.lit("new")), ["doc_id"])


@query(f"""WITH t AS ({TIMELINE}), d AS (SELECT *, end_ts // 86400 AS day FROM t)
    SELECT owner, day, to_json({{'version': 1, 'owner': owner, 'date': day, 'n': count(*), 'records': list({{'id': id, 'end_ts': end_ts, 'app': app, 'page': page, 'seconds': seconds}} ORDER BY id)}})::VARCHAR AS document FROM d GROUP BY owner, day""")
def export_json(spark, d):
    t = act.timeline(activities(spark, d), LO, HI).withColumn("day", F.floor(F.col("end_ts") / 86400).cast("long"))
    return timeline_documents(t)


@query(rf"""WITH found AS (SELECT conv_id, turn, unnest(regexp_extract_all('You need to ' || text, '{tx.TODO}', 1)) AS title FROM conversations),
    named AS (SELECT conv_id AS conversation, turn AS ordinal, substr(trim(regexp_replace(title, '[\s\p{{Z}}]+', ' ', 'g')), 1, 80) AS title FROM found)
    SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY conversation, ordinal) = 1""")
def todo_extract(spark, d):
    """Messages as tasks: each begins with a phrase that names one."""
    return msg.todos(messages(spark, d).withColumn("content", F.concat(F.lit("You need to "), "content")))
