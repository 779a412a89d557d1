"""More named queries: program names, privacy, local time, reports and index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkact.functions import apps, localtime, privacy
from sparkact.functions import text as tx
from sparkact.functions import vectors as vec
from sparkact.operators import reports as rep
from sparkact.queries import ACTS, LO, ORACLE, query
from sparkact.sources.tables import activities, read

NAMES = [" Chrome.exe", "msedge.EXE", "Code", "QQ浏览器", "Tencent Lemon", "my tool.exe", "arc", "Arch", "explorer.exe", "dwm.exe", "Safari ", "swaylock"]
ZONE = "America/New_York"
SHIFT = 68 * 86400  # brings the records to the days on which clocks change


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def named(spark, d):
    return read(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int")).alias("app"))


NAMED = f"named AS (SELECT event_id, ({listed(NAMES)})[event_id % {len(NAMES)} + 1] AS app FROM events)"
BARE = r"trim(regexp_replace(regexp_replace(trim(app), '(\.exe)+$', ''), '(\.EXE)+$', ''))"
ALIAS_ROWS = ", ".join(f"('{a}', '{n}')" for a, n in apps.ALIASES.items())


@query(f"WITH {NAMED}, alias(a, name) AS (VALUES {ALIAS_ROWS}) SELECT coalesce(name, {BARE}) AS name, count(*) AS n FROM named LEFT JOIN alias ON a = lower({BARE}) GROUP BY ALL")
def app_normalise(spark, d):
    return named(spark, d).groupBy(apps.display_name(F.col("app")).alias("name")).agg(F.count("*").alias("n"))


@query(rf"WITH {NAMED} SELECT app, regexp_matches(lower(app), '{'|'.join(apps.BROWSER_PARTS)}') OR lower(app) IN ({listed(list(apps.BROWSER_NAMES))[1:-1]}) AS browser, regexp_replace(lower(app), '(\.exe)+$', '') IN ({listed(apps.SYSTEM)[1:-1]}) AS system, count(*) AS n FROM named GROUP BY ALL")
def app_kinds(spark, d):
    app = F.col("app")
    return named(spark, d).groupBy("app", apps.is_browser(app).alias("browser"), apps.is_system(app).alias("system")).agg(F.count("*").alias("n"))


GLUED = ["iopages", "comx", "dolatest", "org", "usnews"]


@query(rf"WITH u AS (SELECT page_id, 'https://site' || page_id % 9 || '.' || ({listed(GLUED)})[page_id % 5 + 1] || CASE WHEN page_id % 7 = 0 THEN '/x' ELSE '' END AS url FROM pages) SELECT page_id, url FROM u WHERE regexp_matches(url, '^https://[^./]*\.(?i:{'|'.join(apps.MERGED)})[A-Za-z]{{5,}}$')")
def merged_hosts(spark, d):
    glued = F.element_at(F.array(*map(F.lit, GLUED)), (F.col("page_id") % 5 + 1).cast("int"))
    url = F.concat(F.lit("https://site"), F.col("page_id") % 9, F.lit("."), glued, F.when(F.col("page_id") % 7 == 0, "/x").otherwise(""))
    return read(spark, d, "pages").select("page_id", url.alias("url")).where(apps.is_merged_domain(F.col("url")))


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS named FROM documents")
def word_contains(spark, d):
    return read(spark, d, "documents").select("doc_id", apps.contains_word(F.col("text"), "the").alias("named"))


@query(f"WITH {ACTS}, x AS (SELECT id, duration * 97 AS s FROM acts) SELECT id, CASE WHEN s >= 3600 AND s % 3600 // 60 > 0 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' WHEN s >= 3600 THEN s // 3600 || 'h' WHEN s >= 60 THEN s // 60 || 'm' ELSE s || 's' END AS shown FROM x")
def duration_text(spark, d):
    return activities(spark, d).select("id", rep.compact_duration(F.col("duration") * 97).alias("shown"))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def percent_encode(spark, d):
    return read(spark, d, "pages").select("page_id", rep.percent_encoded(F.col("url")).alias("encoded"))


LOCAL = f"""WITH {ACTS}, x AS (SELECT owner, start_ts + {SHIFT} AS a, end_ts + {SHIFT} AS b FROM acts WHERE duration > 0),
    y AS (SELECT *, unnest(generate_series(CAST(timezone('{ZONE}', to_timestamp(a)) AS DATE), CAST(timezone('{ZONE}', to_timestamp(b - 1)) AS DATE), INTERVAL 1 DAY)) AS day FROM x)
    SELECT owner, strftime(day, '%Y-%m-%d') AS date, CAST(sum(least(b, CAST(epoch(timezone('{ZONE}', CAST(day AS TIMESTAMP) + INTERVAL 1 DAY)) AS BIGINT)) - greatest(a, CAST(epoch(timezone('{ZONE}', CAST(day AS TIMESTAMP))) AS BIGINT))) AS BIGINT) AS seconds FROM y GROUP BY ALL"""


@query(LOCAL)
def local_day_totals(spark, d):
    moved = activities(spark, d).withColumns({c: F.col(c) + SHIFT for c in ("start_ts", "end_ts")})
    return rep.local_days(moved, ZONE)


@query(f"WITH {ACTS} SELECT id, strftime(timezone('{ZONE}', to_timestamp(end_ts + {SHIFT})), '%Y-%m-%d') AS date, CAST(epoch(timezone('{ZONE}', date_trunc('day', timezone('{ZONE}', to_timestamp(end_ts + {SHIFT}))))) AS BIGINT) AS day_start, CAST(end_ts + {SHIFT} + 3600 - (end_ts + {SHIFT}) % 3600 AS BIGINT) AS next_hour FROM acts")
def local_bounds(spark, d):
    at = F.col("end_ts") + SHIFT
    return activities(spark, d).select("id", localtime.local_date(at, ZONE).alias("date"), localtime.day_start(at, ZONE).alias("day_start"), localtime.next_hour(at, ZONE).alias("next_hour"))


@query(f"SELECT owner, hour % 24 AS h, app, CAST(sum(seconds) AS BIGINT) AS seconds FROM ({ORACLE['hour_app_attribution']}) GROUP BY ALL")
def hour_app_range(spark, d):
    return rep.hour_app_range(activities(spark, d))


@query(f"WITH {ACTS} SELECT owner, CAST(sum(duration) AS BIGINT) AS work_seconds, CAST(greatest(0, sum(duration) - 1800) AS BIGINT) AS overtime_seconds FROM acts GROUP BY owner")
def flex_overtime(spark, d):
    worked = activities(spark, d).groupBy("owner").agg(F.sum("duration").alias("work_seconds"))
    return rep.flexible_overtime(worked, "work_seconds", 0.5)


@query(f"""WITH {ACTS}, a AS (SELECT *, CAST(floor(end_ts / 86400) AS BIGINT) AS day FROM acts), every AS (SELECT DISTINCT owner, day FROM a),
    sums AS (SELECT owner, day, app, sum(duration) AS seconds, count(DISTINCT CASE WHEN url NOT LIKE '%site3%' THEN url END) AS urls FROM a WHERE app <> 'error' GROUP BY ALL)
    SELECT e.owner, e.day, CAST(coalesce(sum(seconds), 0) AS BIGINT) AS total, count(app) AS n_apps, CAST(coalesce(sum(urls), 0) AS BIGINT) AS n_urls, min_by(app, (-seconds, app)) AS first_app
    FROM every e LEFT JOIN sums b ON b.owner = e.owner AND b.day = e.day GROUP BY ALL""")
def daily_stats_filtered(spark, d):
    shown = rep.without(rep.daily_documents(activities(spark, d)), lambda a: a["app"] == "error", lambda u: F.contains(u["url"], F.lit("site3")))
    n_urls = F.aggregate("apps", F.lit(0).cast("long"), lambda s, a: s + F.size(a["urls"]))
    return shown.select("owner", "day", "total", F.size("apps").cast("long").alias("n_apps"), n_urls.alias("n_urls"), F.get("apps", 0)["app"].alias("first_app"))


@query(f"WITH {ACTS} SELECT app, CAST(sum(duration) AS BIGINT) AS seconds, min_by(left(app || ' at ' || coalesce(url, '-'), 12), (end_ts, id)) AS first_title FROM acts WHERE category = 'browser' GROUP BY app")
def category_drill_down(spark, d):
    return rep.drill_down(activities(spark, d), "browser", F.concat("app", F.lit(" at "), F.coalesce("url", F.lit("-"))), 12)


@query(f"WITH t AS ({ORACLE['timeline']}), s AS (SELECT app, CAST(sum(seconds) AS BIGINT) AS seconds, count(*) AS pages FROM t GROUP BY app) SELECT *, CAST(floor(seconds * 100 / greatest(sum(seconds) OVER (), 1)) AS BIGINT) AS percent FROM s ORDER BY seconds DESC, app LIMIT 15")
def day_app_summary(spark, d):
    from sparkact.queries import timeline

    return rep.app_summary(timeline(spark, d))


@query(f"""WITH {ACTS}, u AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS domain, app, duration, k FROM acts WHERE url IS NOT NULL),
    own AS (SELECT domain, app AS browser, CAST(sum(duration) AS BIGINT) AS seconds FROM u WHERE k % 3 <> 0 GROUP BY ALL)
    SELECT * FROM own UNION ALL SELECT domain, 'other', CAST(sum(duration) - coalesce(sum(duration) FILTER (k % 3 <> 0), 0) AS BIGINT) AS rest FROM u GROUP BY domain HAVING rest > 0""")
def domain_browsers(spark, d):
    return rep.by_browser(activities(spark, d), F.when(F.col("k") % 3 != 0, F.col("app")))


@query(f"""WITH {ACTS}, sums AS (SELECT rtrim(url, '/') AS url, CAST(sum(duration) AS BIGINT) AS seconds, regexp_extract(any_value(url), '^[a-z]+://([^/]*)', 1) AS domain FROM acts WHERE url IS NOT NULL GROUP BY rtrim(url, '/'))
    SELECT *, count(*) OVER (PARTITION BY domain) AS pages FROM sums ORDER BY seconds DESC, url LIMIT 10""")
def top_urls(spark, d):
    return rep.top_urls(activities(spark, d))


@query(f"""WITH {ACTS}, r AS (SELECT id, CAST(floor(end_ts / 86400) AS BIGINT) AS date, app, 't' || id % 9 AS title, app || repeat('.', CAST(duration % 11 AS INT)) AS content, coalesce(regexp_extract(url, '^[a-z]+://([^/]*)', 1), 't' || id % 9) AS place FROM acts),
    f AS (SELECT date, app, place, title, min(id) AS first FROM r GROUP BY ALL), t AS (SELECT date, app, place, array_to_string(list_slice(list(title ORDER BY first), 1, 5), ' | ') AS titles FROM f GROUP BY ALL)
    SELECT r.date, r.app, r.place, any_value(titles) AS titles, max_by(content, (length(content), id)) AS content, max(id) AS last_id FROM r JOIN t ON t.date = r.date AND t.app = r.app AND t.place = r.place GROUP BY r.date, r.app, r.place""")
def memory_chunks(spark, d):
    title = F.concat(F.lit("t"), F.col("id") % 9)
    return rep.memory_chunks(activities(spark, d), title, F.concat("app", F.expr("repeat('.', cast(duration % 11 AS int))")))


@query("""WITH o AS (SELECT doc_id, lang || repeat('a', CAST(n_chars % 5 AS INT)) AS c FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, lang || repeat('b', CAST(n_chars % 7 AS INT)) AS c FROM documents WHERE doc_id % 2 = 0)
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.c IS NULL OR length(n.c) > length(o.c) THEN n.c ELSE o.c END AS content, NOT (o.c IS NULL OR coalesce(length(n.c) > length(o.c), false)) AS embedded FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def keep_longest(spark, d):
    docs = read(spark, d, "documents")
    old = docs.where("doc_id % 3 <> 0").select("doc_id", F.expr("concat(lang, repeat('a', cast(n_chars % 5 AS int)))").alias("content"), F.array(F.lit(1.0)).alias("vector"))
    new = docs.where("doc_id % 2 = 0").select("doc_id", F.expr("concat(lang, repeat('b', cast(n_chars % 7 AS int)))").alias("content"))
    return rep.keep_longest(old, new, ["doc_id"]).select("doc_id", "content", F.col("vector").isNotNull().alias("embedded"))


@query("WITH c AS (SELECT sha256(doc_id || '') AS chunk_key, doc_id FROM documents WHERE doc_id % 4 = 0) SELECT * FROM c WHERE chunk_key > '1' ORDER BY chunk_key LIMIT 32")
def embedding_queue(spark, d):
    vector = F.when(F.col("doc_id") % 4 != 0, F.array(F.lit(1.0)))
    chunks = read(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_key"), vector.alias("vector"))
    return rep.embedding_queue(chunks, "1").drop("vector")


@query(f"WITH {ACTS} SELECT id, end_ts, app FROM acts WHERE coalesce(url, '') = '' AND end_ts >= {LO} ORDER BY end_ts DESC, id DESC LIMIT 50")
def missing_urls(spark, d):
    return rep.missing_urls(activities(spark, d, since=LO), LO, 50)


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM events ORDER BY date DESC LIMIT 20")
def report_dates(spark, d):
    return rep.report_dates(activities(spark, d), 20)


@query("WITH b AS (SELECT n_name, n_nationkey AS pos, list_position(['JAPAN', 'FRANCE', 'KENYA'], n_name) AS p FROM nation) SELECT n_name, row_number() OVER (ORDER BY coalesce(CASE WHEN p > 0 THEN p END, 1000 + pos)) AS rank FROM b")
def block_order(spark, d):
    blocks = read(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("at"))
    return rep.in_order(blocks, "n_name", ["JAPAN", "FRANCE", "KENYA"]).select("n_name", "rank")


@query("WITH w AS (SELECT DISTINCT doc_id FROM documents), t AS (SELECT DISTINCT doc_id + 5 AS doc_id FROM labels) SELECT doc_id, 'missing' AS side FROM (SELECT * FROM w EXCEPT SELECT * FROM t) UNION ALL SELECT doc_id, 'extra' FROM (SELECT * FROM t EXCEPT SELECT * FROM w)")
def coverage_gaps(spark, d):
    return rep.coverage_gaps(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select((F.col("doc_id") + 5).alias("doc_id")), ["doc_id"])


@query(f"WITH {ACTS}, g AS (SELECT owner, id, app, lag(app) OVER w AS previous, start_ts - lag(end_ts) OVER w AS gap FROM acts WINDOW w AS (PARTITION BY owner ORDER BY end_ts, id)) SELECT * FROM g WHERE app <> previous AND gap BETWEEN 1 AND 599")
def switch_backfill(spark, d):
    return rep.backfilled(activities(spark, d))


ACTION = """CASE WHEN lower(app) LIKE '%purch%' THEN 'skip' WHEN lower(app) LIKE '%err%' THEN 'anonymize' WHEN 'k ' || k LIKE '%k 5%' THEN 'anonymize'
    WHEN regexp_extract(url, '^[a-z]+://([^/]*)', 1) = 'site3.example.org' OR ends_with(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '.site3.example.org') THEN 'skip' ELSE 'record' END"""


def what(df):
    return privacy.action(F.col("app"), F.concat(F.lit("k "), F.col("k")), F.col("url"), [("Purch", "skip"), ("err", "anonymize")], ["K 5"], ["site3.example.org"])


@query(f"WITH {ACTS} SELECT id, {ACTION} AS action FROM acts")
def privacy_action(spark, d):
    a = activities(spark, d)
    return a.select("id", what(a).alias("action"))


@query(f"WITH {ACTS}, x AS (SELECT *, {ACTION} AS action FROM acts) SELECT id, app, CASE WHEN action = 'anonymize' THEN NULL ELSE url END AS url, CASE WHEN action = 'anonymize' THEN 'hidden' ELSE category END AS category FROM x WHERE action <> 'skip'")
def privacy_filtered(spark, d):
    a = activities(spark, d)
    return privacy.applied(a, what(a), ["url", "category"], {"category": "hidden"}).select("id", "app", "url", "category")


@query(f"WITH {NAMED} SELECT event_id FROM named WHERE NOT (contains(lower(app), 'chrome') OR contains(lower(app), 'lemon'))")
def ignored_apps(spark, d):
    return named(spark, d).where(~privacy.ignored(F.col("app"), ["Chrome", "LEMON"])).select("event_id")


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, len(e) = 64 AND abs(sqrt(list_sum(list_transform(e, lambda x: x * x))) - 1) <= 1e-4 AS valid FROM v")
def unit_vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", ((F.size("embedding") == 64) & (F.abs(vec.norm(F.col("embedding")) - 1) <= 1e-4)).alias("valid"))


@query("SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) AS n FROM documents")
def search_terms(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(tx.pretokens(F.col("text"))).cast("long").alias("n"))


ORACLE["sha_key"] = "SELECT conv_id AS conversation, turn AS ordinal, sha256(from_hex(printf('%016x', octet_length(encode(role)))) || encode(role) || from_hex(printf('%016x', octet_length(encode(text)))) || encode(text)) AS message_key FROM conversations"
