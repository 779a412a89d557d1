"""More named queries: authorised retrieval, record maintenance and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkact.operators import activity as act
from sparkact.operators import records as rec
from sparkact.queries import ACTS, DAY0, HI, LO, query
from sparkact.report_queries import NAMED, listed, named
from sparkact.sources.tables import activities, read


@query("""WITH g AS (SELECT n_nationkey AS generation FROM nation WHERE n_nationkey = 7),
    conv AS (SELECT c_custkey AS conversation, c_custkey % 5 AS active_import FROM customer),
    mapping AS (SELECT conversation, conversation % 3 AS i FROM conv), imports AS (SELECT range AS i FROM range(5) WHERE range <> 1)
    SELECT o_orderkey AS chunk FROM orders JOIN g ON o_orderkey % 2 + 6 = generation JOIN conv ON conversation = o_custkey JOIN mapping USING (conversation) JOIN imports USING (i) WHERE i = active_import""")
def authorised_chunks(spark, d):
    chunks = read(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("conversation"), (F.col("o_orderkey") % 2 + 6).alias("generation"))
    conversations = read(spark, d, "customer").select(F.col("c_custkey").alias("conversation"), (F.col("c_custkey") % 5).alias("active_import"))
    mapping = conversations.select(F.col("conversation").alias("mapped_conversation"), (F.col("conversation") % 3).alias("import"), F.lit(7).alias("generation"))
    imports = spark.range(5).select(F.col("id").alias("import"), F.when(F.col("id") == 1, "retired").otherwise("active").alias("status"))
    key = F.col("n_nationkey")
    generations = read(spark, d, "nation").select(key.alias("generation"), F.when(key == 7, "ready").otherwise("building").alias("status"), key.alias("completed_at"), F.concat(F.lit("s"), key).alias("snapshot"))
    catalog = spark.range(1).select(F.lit(7).alias("active_generation"), F.lit("s7").alias("active_snapshot"))
    return rec.authorised(chunks, conversations, mapping, imports, generations, catalog).select("chunk")


@query(f"WITH {NAMED} SELECT event_id, app FROM named WHERE lower(trim(app)) IN ('chrome.exe', 'chrome')")
def normalised_app_rows(spark, d):
    return rec.by_display_name(named(spark, d), "chrome")


@query(f"WITH {ACTS} SELECT id, end_ts, app FROM acts WHERE app = 'view' AND (end_ts, id) > ({LO}, 5) ORDER BY end_ts, id LIMIT 40")
def trace_page(spark, d):
    after = rec.cursor([LO, 5], {"app": "view"})
    return rec.trace_page(activities(spark, d), 40, after, app="view").select("id", "end_ts", "app")


@query(f"""WITH {ACTS}, u AS (SELECT app AS browser, regexp_extract(url, '^https://([^/]*)', 1) AS domain, duration FROM acts WHERE url IS NOT NULL),
    t AS (SELECT domain, sum(duration) AS s FROM u GROUP BY domain ORDER BY s DESC, domain LIMIT 6)
    SELECT browser, domain, CAST(sum(duration) AS BIGINT) AS seconds FROM u WHERE domain IN (SELECT domain FROM t) GROUP BY ALL""")
def homepage_browsers(spark, d):
    a = activities(spark, d)
    return rec.homepage(act.domain_usage(a), act.browser_rollup(a).where("page is null and domain is not null").select("browser", "domain", "seconds"))


RULES = [("view", "reading"), ("error", "incident")]


@query(f"WITH {ACTS}, u AS (SELECT app, max_by(category, (end_ts, id)) AS category, CAST(sum(duration) AS BIGINT) AS seconds FROM acts GROUP BY app) SELECT app, seconds, CASE app WHEN 'view' THEN 'reading' WHEN 'error' THEN 'incident' ELSE category END AS category, app IN ('view', 'error') AS overridden FROM u")
def category_override(spark, d):
    usage = activities(spark, d).groupBy("app").agg(F.max_by("category", F.struct("end_ts", "id")).alias("category"), F.sum("duration").alias("seconds"))
    return rec.overridden(usage, spark.createDataFrame(RULES, "app string, category string"))


@query(f"WITH {ACTS} SELECT id, CASE WHEN app = 'view' AND k > 50 THEN 'reading' ELSE category END AS category FROM acts")
def reclassify(spark, d):
    return rec.reclassified(activities(spark, d), (F.col("app") == "view") & (F.col("k") > 50), F.lit("reading")).select("id", "category")


@query(f"""WITH {ACTS}, a AS (SELECT *, CAST(floor(end_ts / 3600) AS BIGINT) AS hour FROM acts), h AS (SELECT owner, hour, CAST(sum(duration) AS BIGINT) AS seconds, list_sort(list(DISTINCT app)) AS apps, list_sort(coalesce(list(DISTINCT url) FILTER (url IS NOT NULL), [])) AS urls FROM a GROUP BY ALL)
    SELECT owner, hour, 'Used ' || array_to_string(apps, ', ') || ' for ' || (seconds + 30) // 60 || ' min' || CASE WHEN len(urls) > 0 THEN ', on ' || regexp_extract(urls[1], '//([^/:]*)', 1) || CASE WHEN len(urls) > 1 THEN ' and ' || (len(urls) - 1) || ' more' ELSE '' END ELSE '' END AS said FROM h""")
def hour_text(spark, d):
    a = activities(spark, d).withColumn("hour", F.floor(F.col("end_ts") / 3600))
    hours = a.groupBy("owner", "hour").agg(F.sum("duration").alias("seconds"), F.array_sort(F.collect_set("app")).alias("apps"), F.array_sort(F.collect_set("url")).alias("urls"))
    return rec.hour_text(hours).select("owner", "hour", "said")


@query(f"WITH {ACTS} SELECT id, k / 100.0 AS confidence FROM acts WHERE k > 30 AND duration % 3 <> 0 ORDER BY confidence DESC, end_ts DESC, id LIMIT 25")
def active_insights(spark, d):
    rows = activities(spark, d).select("id", (F.col("k") / 100.0).alias("confidence"), F.col("end_ts").alias("created_at"), (F.col("duration") % 3 == 0).alias("archived"))
    return rec.active_insights(rows, 25).select("id", "confidence")


@query("""WITH e AS (SELECT n_name AS title, n_nationkey AS date, CAST(50 + n_nationkey AS INT) AS confidence FROM nation WHERE n_nationkey < 12),
    m AS (SELECT lower(n_name) AS title, n_nationkey AS date FROM nation), r AS (SELECT lower(n_name) || '' AS t FROM nation WHERE n_nationkey < 12)
    SELECT * FROM (SELECT * FROM e UNION ALL SELECT title, date, 96 FROM m WHERE title NOT IN (SELECT t FROM r)) ORDER BY confidence DESC, date DESC, title LIMIT 20""")
def merged_todos(spark, d):
    n = read(spark, d, "nation").select(F.col("n_name").alias("title"), F.col("n_nationkey").alias("date"))
    manual = n.select(F.concat(F.lower("title"), F.lit(" ")).alias("title"), "date", F.col("date").alias("at"))
    return rec.with_manual(n.where("date < 12").withColumn("confidence", (F.col("date") + 50).cast("int")), manual).withColumn("title", F.rtrim("title"))


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_keys(spark, d):
    return rec.repeated_keys(read(spark, d, "orders"), ["o_custkey"])


TYPED = ["Example.org/a/", "localhost:3000/x", "10.0.0.1/y/", "not an url", "about:blank", "https://a.b/c.", "300.1.1.1", "foo", "-bad.org", "a.toolongtoplevel", "x.co.", "shop.example:8080"]
SHOWN = ["https://Example.org/a", "http://localhost:3000/x", "http://10.0.0.1/y", None, "about:blank", "https://a.b/c", None, None, None, None, "https://x.co", "https://shop.example:8080"]


def literal(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(f"SELECT event_id, ({listed(TYPED)})[event_id % 12 + 1] AS typed, ({literal(SHOWN)})[event_id % 12 + 1] AS url FROM events")
def canonical_urls(spark, d):
    typed = F.element_at(F.array(*map(F.lit, TYPED)), (F.col("event_id") % 12 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", typed.alias("typed")).withColumn("url", rec.canonical_url(F.col("typed")))


@query(f"SELECT event_id, ({literal(['https://' + t for t in ('x.org/1', 'docs.example.com', 'a.io')] + [None])})[event_id % 4 + 1] AS hint FROM events")
def page_hints(spark, d):
    titles = F.array(*map(F.lit, ["x.org/1 - Browser", "Home page - docs.example.com - Browser", "Read me - a.io", "No address here"]))
    return read(spark, d, "events").select("event_id", rec.page_hint(F.element_at(titles, (F.col("event_id") % 4 + 1).cast("int"))).alias("hint"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_slice(list_filter(string_split_regex(role || ' a ' || turn, '[^\p{L}\p{N}_-]+'), lambda x: length(x) BETWEEN 2 AND 30), 1, 3)
        || list_slice(list_filter(string_split_regex(text, '[^\p{L}\p{N}_-]+'), lambda x: length(x) BETWEEN 2 AND 20 AND regexp_full_match(x, '\p{L}+')), 1, 5) AS ws FROM conversations),
    p AS (SELECT conv_id, ws[i] AS word, min({'t': turn, 'i': i}) AS first FROM w, unnest(range(1, len(ws) + 1)) AS u(i) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS n FROM p) SELECT conv_id, list(word ORDER BY first) AS words FROM k WHERE n <= 30 GROUP BY conv_id""")
def report_keywords(spark, d):
    rows = read(spark, d, "conversations").withColumn("title", F.concat_ws(" a ", "role", F.col("turn").cast("string")))
    return rec.report_keywords(rows, ["conv_id"], "title", "text", ["turn"])


@query(r"""WITH x AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda v: regexp_replace(regexp_replace(v, '[\x00-\x08\x0a-\x1f\x7f]', '', 'g'), '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents),
    y AS (SELECT doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS q FROM x) SELECT doc_id, CASE WHEN q <> '' AND length(q) <= 8192 AND octet_length(encode(q)) <= 32768 THEN sha256(q) END AS digest FROM y""")
def normal_queries(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(rec.normal_query(F.col("text")), 256).alias("digest"))


@query("""SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN '{"title":"t' || page_id || '","url":"u"}' END AS extra FROM pages""")
def canonical_json(spark, d):
    other = F.when(F.col("page_id") % 3 == 0, "secret").otherwise("title")
    pairs = F.create_map(F.lit("url"), F.lit("u"), other, F.concat(F.lit("t"), F.col("page_id")))
    return read(spark, d, "pages").select("page_id", rec.canonical_json(pairs, ["title", "description", "url"]).alias("extra"))


@query(f"WITH {ACTS} SELECT id, k > 20 AND (duration * 20 >= 600 OR id % 2 = 1) AS idle FROM acts")
def idle_gate(spark, d):
    return activities(spark, d).select("id", rec.idle(F.col("k") > 20, F.col("duration") * 20, F.col("id") % 2 == 0).alias("idle"))


@query(f"WITH {ACTS}, g AS (SELECT *, CAST(floor(end_ts / 86400) AS BIGINT) AS day FROM acts) SELECT DISTINCT day FROM g WHERE day NOT IN (SELECT day FROM g WHERE app = 'error' AND end_ts < {HI})")
def invalidated_reports(spark, d):
    a = activities(spark, d)
    reports = a.select(F.floor(F.col("end_ts") / 86400).alias("day")).distinct()
    return rec.deleted(a, reports, (F.col("app") == "error") & (F.col("end_ts") < HI))[1]


@query(f"WITH {ACTS} SELECT id FROM acts WHERE NOT (app = 'error' AND end_ts < {HI})")
def after_delete(spark, d):
    a = activities(spark, d)
    return rec.deleted(a, a.select(F.lit(DAY0).alias("day")), (F.col("app") == "error") & (F.col("end_ts") < HI))[0].select("id")


@query("""WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS date, ' ' || count(*) || ' records ' AS content FROM events GROUP BY ALL)
    SELECT date, '## ' || date || chr(10) || chr(10) || trim(content) || chr(10) || chr(10) || '---' || chr(10) AS section FROM r WHERE date BETWEEN '2024-01-03' AND '2024-01-12'""")
def report_markdown(spark, d):
    days = read(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.concat(F.lit(" "), F.count("*"), F.lit(" records ")).alias("content"))
    return rec.markdown(days, "2024-01-03", "2024-01-12")


@query("SELECT doc_id, text AS excerpt FROM documents WHERE doc_id % 4 <> 1 AND text IS NOT NULL")
def receipts(spark, d):
    docs = read(spark, d, "documents")
    noted = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return rec.still_true(noted, docs, "doc_id", "text")


@query(f"WITH {ACTS}, x AS (SELECT id, k / 100.0 AS c, duration / 100.0 AS n FROM acts), y AS (SELECT *, least(1, greatest(0, c * 0.7 + n * 0.3)) AS aim FROM x) SELECT id, CASE WHEN abs(aim - c) > 0.05 THEN aim ELSE c END AS value FROM y")
def average_update(spark, d):
    return activities(spark, d).select("id", rec.average_towards((F.col("k") / 100.0), F.col("duration") / 100.0).alias("value"))
