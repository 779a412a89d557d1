"""Queries that classify records, and SQL that tries every needle of every rule on every record."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkact.functions.rules import RuleSet
from sparkact.operators import classification as cls
from sparkact.queries import query
from sparkact.sources.tables import read

# What events are about: a program by the number in props, a title by the event, an address by the user.
APPS = ["Google Chrome", "Code.exe", "Zoom", "微信", "微信读书", "Obsidian", "OBS", "obs studio", "Arc", "qqbrowser", "Figma", "Spotify", "Steam", "MongoDB Compass", "community", "java.exe", "Slack", "QQ", "Safari", "Jira", "pdf reader", "Music"]
TITLES = ["main.rs - pull request", "项目例会 meeting", "日报 草稿", "Tauri Guide docs", "ChatGPT prompt", "search 对比", "sprint backlog", "playlist album", "直播 游戏", "IntelliJ IDEA", "群聊 讨论", "设计稿 frame", "", "bug report error", "code review diff", "推荐 社区", "lesson 教程"]
URLS = ["https://github.com/a/b/pull/1", "https://github.com/a/wiki", "https://docs.google.com/document/d/1", "https://x.com/home", "https://chatgpt.com/c/1", "https://www.youtube.com/watch?v=1", "https://linear.app/board", "https://www.google.com/search?q=1", "https://unknown.example/x", None, "https://intra.example/"]
SETTINGS = cls.Settings(
    app_rules=[("Zoom", "meetings"), ("figma desktop app", "office"), ("slac", "development"), ("Slack", "other")],
    categories=("development", "browser", "communication", "office", "entertainment", "other"),
    meanings=tuple(m for m in cls.MEANING_BASE if m != "音乐音频"),
    domains={"github.com": ("development", "编码开发"), "x.com": ("entertainment", "休息娱乐"), "google.com": ("browser", "资料调研"), "docs.google.com": ("office", "内容撰写"), "example": ("browser", "资料阅读")},
    website_rules=[("linear.app", "任务规划"), ("chatgpt.com", "AI 协作"), ("chatgpt.com", "休息娱乐"), ("intra.example", "own work")],
)
LEARNED = [("app:community", "communication", "即时聊天"), ("domain:www.youtube.com", "entertainment", "视频内容"), ("app:java.exe", "gone", "编码开发"), ("app:jira", "office", "音乐音频")]


def quoted(x: str | int | None) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(rows: Iterable[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def listed(items: Iterable) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


NAMED = f"""named AS (SELECT event_id AS id, {listed(APPS)}[CAST(json_extract_string(props, '$.k') AS BIGINT) % {len(APPS)} + 1] AS app,
    {listed(TITLES)}[event_id % {len(TITLES)} + 1] AS title, {listed(URLS)}[user_id % {len(URLS)} + 1] AS url FROM events),
    seen AS (SELECT DISTINCT app, title, coalesce(url, '') AS url FROM named)"""
FITS = """CASE mode WHEN 'start' THEN starts_with(t, needle) WHEN 'word' THEN regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(needle) || '($|[^a-z0-9])') ELSE contains(t, needle) END
    AND (unless IS NULL OR NOT contains(t, unless))"""


def fired(name: str, rules: RuleSet, table: str, key: str) -> str:
    """SQL of {name}(key.., rule, label, points, n): the rules that hold, with how many needles were found."""
    fields = "CASE field " + " ".join(f"WHEN '{f}' THEN lower(coalesce({f}, ''))" for f in rules.fields) + " END"
    forbidden = list(rules.forbidden()) or [(-1, "", "")]
    return f"""{name}_needles(rule, label, points, field, mode, needle, unless) AS ({values(rules.rows())}),
    {name}_none(rule, field, needle) AS ({values(forbidden)}),
    {name}_texts AS (SELECT {key}, field, {fields} AS t FROM {table}, (SELECT DISTINCT field FROM {name}_needles)),
    {name} AS (SELECT {key}, rule, label, points, count(*) AS n FROM {name}_texts JOIN {name}_needles USING (field) WHERE {FITS} GROUP BY ALL
        EXCEPT SELECT {key}, n.rule, n.label, n.points, n.n FROM (SELECT {key}, rule, label, points, count(*) AS n FROM {name}_texts JOIN {name}_needles USING (field) WHERE {FITS} GROUP BY ALL) n
            JOIN {name}_none x USING (rule) JOIN {name}_texts t USING ({key}) WHERE t.field = x.field AND contains(t.t, x.needle))"""


KEY = "app, title, url"
BUILT_IN = f"""{fired('based', cls.BASE, 'seen', KEY)},
    built AS (SELECT app, title, url, coalesce(b.label, 'other') AS base FROM seen LEFT JOIN (SELECT {KEY}, min_by(label, rule) AS label FROM based GROUP BY ALL) b USING ({KEY}))"""


def meaning_sql(table: str) -> str:
    """SQL of meant(app, title, url, base, label, confidence) for a table with a column base."""
    return f"""{fired('hits', cls.SEMANTIC, table, KEY)},
    extra(base, label, points) AS ({values((k, *v) for k, v in cls.BASE_POINTS.items())}),
    points AS (SELECT {KEY}, label, sum(points) AS points FROM (SELECT {KEY}, label, points FROM hits
        UNION ALL SELECT {KEY}, coalesce(e.label, b.base), coalesce(e.points, {cls.OWN_CATEGORY_POINTS}) FROM {table} b LEFT JOIN extra e USING (base) WHERE b.base <> 'other') GROUP BY ALL),
    places AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY points DESC, label) AS k, coalesce(lead(points) OVER (PARTITION BY {KEY} ORDER BY points DESC, label), 0) AS second FROM points),
    least(label, least) AS ({values(cls.THRESHOLDS.items())}),
    meant AS (SELECT b.app, b.title, b.url, b.base, CASE WHEN p.label IS NULL OR p.points < coalesce(l.least, {cls.OTHER_THRESHOLD}) OR (p.label IN {cls.GUARDED} AND p.points - p.second < {cls.LEAD}) THEN '{cls.UNKNOWN}' ELSE p.label END AS label,
        CASE WHEN p.label IS NULL THEN 20 WHEN p.points < coalesce(l.least, {cls.OTHER_THRESHOLD}) OR (p.label IN {cls.GUARDED} AND p.points - p.second < {cls.LEAD}) THEN 45
            ELSE least(greatest(p.points + p.points - p.second, 55), 98) END::INTEGER AS confidence
        FROM {table} b LEFT JOIN (FROM places WHERE k = 1) p USING ({KEY}) LEFT JOIN least l ON l.label = p.label)"""


def named(spark: SparkSession, d: str) -> DataFrame:
    """Events as records of a program, a title and an address."""
    at = lambda items, i: F.element_at(F.array(*map(F.lit, items)), (i % len(items) + 1).cast("int"))
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), at(APPS, F.get_json_object("props", "$.k").cast("long")).alias("app"), at(TITLES, F.col("event_id")).alias("title"), at(URLS, F.col("user_id")).alias("url"))


@query(f"WITH {NAMED}, {BUILT_IN} SELECT id, base AS base_category FROM named n JOIN built b ON b.app = n.app AND b.title = n.title AND b.url = coalesce(n.url, '')")
def base_category(spark: SparkSession, d: str) -> DataFrame:
    return cls.with_meaning(named(spark, d)).select("id", "base_category")


@query(f"WITH {NAMED}, {BUILT_IN}, {meaning_sql('built')} SELECT id, label AS meaning, confidence FROM named n JOIN meant b ON b.app = n.app AND b.title = n.title AND b.url = coalesce(n.url, '')")
def semantic_label(spark: SparkSession, d: str) -> DataFrame:
    return cls.with_meaning(named(spark, d)).select("id", "meaning", "confidence")


OWN = [(i, a.lower(), b if b in SETTINGS.categories else "other") for i, (a, b) in enumerate(SETTINGS.app_rules)]
SHOWN = {"Code.exe": "vs code", "Arc": "arc", "qqbrowser": "qq browser", "java.exe": "java"}  # how the programs of APPS are displayed where that differs


@query(f"""WITH {NAMED}, {BUILT_IN}, shown(app, name) AS ({values((a, SHOWN.get(a, a.lower())) for a in APPS)}), own(rule, name, label) AS ({values(OWN)}),
    ruled AS (SELECT s.app, min_by(o.label, o.rule) AS label FROM shown s JOIN own o ON s.name = o.name OR (strlen(o.name) >= 3 AND contains(s.name, o.name)) OR (strlen(s.name) >= 3 AND contains(o.name, s.name)) GROUP BY s.app),
    domains(suffix, kb, kb_meaning) AS ({values((k, *v) for k, v in SETTINGS.domains.items())}), learned(ask, cat, hint) AS ({values(LEARNED)}), sites(host, ruling) AS ({values(dict(reversed(SETTINGS.website_rules)).items())}),
    meaning_base(ruling, base) AS ({values(cls.MEANING_BASE.items())}),
    one AS (SELECT b.app, b.title, b.url, coalesce(r.label, b.base) AS base, lower(regexp_extract(b.url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)', 1)) AS host FROM built b LEFT JOIN ruled r USING (app)),
    two AS (SELECT o.app, o.title, o.url, o.host, CASE WHEN o.base IN {SETTINGS.categories} THEN o.base ELSE 'other' END AS base, max_by(k.kb, length(k.suffix)) AS kb, max_by(k.kb_meaning, length(k.suffix)) AS kb_meaning
        FROM one o LEFT JOIN domains k ON o.host = k.suffix OR ends_with(o.host, '.' || k.suffix) GROUP BY ALL),
    three AS (SELECT * REPLACE (CASE WHEN base = 'browser' AND kb <> 'browser' AND kb IN {SETTINGS.categories} THEN kb ELSE base END AS base) FROM two),
    four AS (SELECT t.app, t.title, t.url, t.host, coalesce(l.cat, t.base) AS base, coalesce(l.hint, t.kb_meaning) AS hint FROM three t LEFT JOIN learned l ON l.cat IN {SETTINGS.categories}
        AND l.ask = CASE WHEN t.base = 'other' THEN 'app:' || lower(t.app) WHEN t.base = 'browser' AND t.kb IS NULL AND t.host <> '' THEN 'domain:' || t.host END),
    {meaning_sql('four')},
    five AS (SELECT m.*, f.host, confidence < 70 AND coalesce(f.hint IN {SETTINGS.meanings}, false) AS unsure, f.hint FROM meant m JOIN four f USING ({KEY})),
    done AS (SELECT f.app, f.title, f.url, CASE WHEN s.ruling IS NULL THEN f.base ELSE coalesce(mb.base, f.base) END AS base_category,
        coalesce(s.ruling, CASE WHEN unsure THEN hint WHEN label IN {SETTINGS.meanings} THEN label ELSE '{cls.UNKNOWN}' END) AS meaning, CASE WHEN s.ruling IS NOT NULL THEN 100 WHEN unsure THEN 70 ELSE confidence END AS confidence
        FROM five f LEFT JOIN sites s ON s.host = f.host LEFT JOIN meaning_base mb ON mb.ruling = s.ruling)
    SELECT id, base_category, meaning, confidence FROM named n JOIN done b ON b.app = n.app AND b.title = n.title AND b.url = coalesce(n.url, '')""")
def resolved_category(spark: SparkSession, d: str) -> DataFrame:
    learned = spark.createDataFrame(LEARNED, "key string, category string, meaning string")
    return cls.resolved(named(spark, d), SETTINGS, learned).select("id", "base_category", "meaning", "confidence")


SESSION = "id // 10"  # ten records in a row


@query(f"""WITH {NAMED}, {BUILT_IN}, lines AS (SELECT {SESSION} AS session, n.app, n.title, n.url, b.base FROM named n JOIN built b ON b.app = n.app AND b.title = n.title AND b.url = coalesce(n.url, '')),
    texts AS (SELECT session, max(base) AS category, max(app) AS app, max(title) AS title, coalesce(string_agg(DISTINCT url, ' ' ORDER BY url), '') AS domains, string_agg(DISTINCT title, ' ' ORDER BY title) AS keywords,
        string_agg(DISTINCT app || ' ' || title, ' ' ORDER BY app || ' ' || title) AS corpus FROM lines GROUP BY session),
    {fired('needles', cls.INTENT, 'texts', 'session')}, {fired('bonus', cls.INTENT_BONUS, 'texts', 'session')},
    sums AS (SELECT session, label, sum(points)::BIGINT AS points FROM (SELECT session, label, points * n AS points FROM needles UNION ALL SELECT session, label, points FROM bonus) GROUP BY ALL)
    SELECT session, coalesce(min_by(s.label, (-s.points, s.label)), '{cls.NO_INTENT}') AS intent, (40 + coalesce(max(s.points), 0))::INTEGER AS score FROM texts LEFT JOIN sums s USING (session) GROUP BY session""")
def session_intent(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of ten records; their texts are the distinct names and titles, of which there are few."""
    lines = cls.with_meaning(named(spark, d)).withColumn("session", F.floor(F.col("id") / 10))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " ")
    texts = lines.groupBy("session").agg(
        F.max("base_category").alias("category"), F.max("app").alias("app"), F.max("title").alias("title"), joined("url").alias("domains"), joined("title").alias("keywords"),
        joined(F.concat_ws(" ", "app", "title")).alias("corpus"),
    )
    return cls.session_intents(texts).select("session", "intent", "score")
