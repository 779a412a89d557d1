"""Authorised retrieval, record maintenance, and the columns that records are cleaned with."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkact.functions import apps
from sparkact.functions import text as tx
from sparkact.operators.activity import top_by_group


def authorised(chunks: DataFrame, conversations: DataFrame, mapping: DataFrame, imports: DataFrame, generations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Chunks of the catalog's active index generation, if that is ready and of the catalog's
    snapshot, in conversations whose active import is the generation's own and itself active.
    The catalog is one row and generations are few, so Spark broadcasts these by their size;
    the join of chunks with conversations shuffles on the conversation."""
    active = (
        catalog.join(generations.where("status = 'ready' and completed_at is not null"), (F.col("active_generation") == F.col("generation")) & (F.col("active_snapshot") == F.col("snapshot")))
        .select("generation")
    )
    mapped = mapping.join(active, "generation").join(imports.where("status = 'active'").select("import"), "import")
    served = conversations.join(mapped, (F.col("conversation") == F.col("mapped_conversation")) & (F.col("active_import") == F.col("import"))).select("conversation", "generation")
    return chunks.join(served, ["conversation", "generation"], "left_semi")


def by_display_name(acts: DataFrame, name: str, column: str = "app") -> DataFrame:
    """Rows of all the raw names that show as ``name``."""
    return acts.where(apps.display_name(F.col(column)) == apps.display_name(F.lit(name)))


def traces(events: DataFrame, since: int | None = None, until: int | None = None, **equal) -> DataFrame:
    """Rows inside the bounds given (``since`` inside, ``until`` not) and equal in the columns given."""
    for bound, op in ((since, ">="), (until, "<")):
        if bound is not None:
            events = events.where(f"end_ts {op} {int(bound)}")
    for column, value in equal.items():
        if value is not None:
            events = events.where(F.col(column) == value)
    return events


def cursor(position: list, filters: dict) -> str:
    """An opaque text of a position and the filters that it belongs to."""
    return base64.urlsafe_b64encode(json.dumps([position, filters], sort_keys=True).encode()).decode().rstrip("=")


def position_of(text: str, filters: dict) -> list:
    """The position of :func:`cursor`; ValueError for other filters or a text that is none."""
    position, known = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    if known != json.loads(json.dumps(filters)):
        raise ValueError("the cursor belongs to other filters")
    return position


def trace_page(events: DataFrame, n: int, after: str | None = None, **filters) -> DataFrame:
    """The next ``n`` rows by (end_ts, id) after an opaque cursor."""
    rows = traces(events, **filters)
    if after:
        ts, number = map(int, position_of(after, filters))
        rows = rows.where(f"end_ts > {ts} or (end_ts = {ts} and id > {number})")
    return rows.orderBy("end_ts", "id").limit(n)


def homepage(domains: DataFrame, browsers: DataFrame, n: int = 6) -> DataFrame:
    """Rows of ``browsers`` in the ``n`` largest domains, compared without case."""
    top = domains.orderBy(F.desc("seconds"), "domain").limit(n).select(F.lower("domain").alias("_shown"))
    return browsers.join(F.broadcast(top), F.lower("domain") == F.col("_shown"), "left_semi")  # n rows


def overridden(usage: DataFrame, rules: DataFrame) -> DataFrame:
    """``usage`` by app with the rule's category where there is one, and whether there is."""
    own = rules.select(F.col("app"), F.col("category").alias("_rule"))
    return usage.join(own, "app", "left").select(*[c for c in usage.columns if c != "category"], F.coalesce("_rule", "category").alias("category"), F.col("_rule").isNotNull().alias("overridden"))


def reclassified(acts: DataFrame, which: Column, category: Column) -> DataFrame:
    """``acts`` with another category on the rows of ``which``."""
    return acts.withColumn("category", F.when(which, category).otherwise(F.col("category")))


def hour_text(hours: DataFrame) -> DataFrame:
    """A sentence about an hour from its apps, seconds and urls."""
    minutes = F.floor((F.col("seconds") + 30) / 60)
    rest = F.when(F.size("urls") > 1, F.concat(F.lit(" and "), F.size("urls") - 1, F.lit(" more"))).otherwise("")
    sites = F.when(F.size("urls") > 0, F.concat(F.lit(", on "), F.regexp_extract(F.get("urls", 0), r"^(?:.*?//)?([^/:]*)", 1), rest)).otherwise("")
    said = F.concat(F.lit("Used "), F.array_join(F.slice("apps", 1, 5), ", "), F.lit(" for "), minutes, F.lit(" min"), sites)
    return hours.withColumn("said", F.when(F.size("apps") == 0, "No activity").otherwise(said))


def active_insights(insights: DataFrame, n: int, least: float = 0.3) -> DataFrame:
    return insights.where((F.col("confidence") > least) & ~F.col("archived")).orderBy(F.desc("confidence"), F.desc("created_at"), "id").limit(n)


def with_manual(extracted: DataFrame, manual: DataFrame, n: int = 20, confidence: int = 96) -> DataFrame:
    """Extracted to-dos and those manual ones whose title is new without case and outer space;
    the ``n`` best. Extracted rows stay as they are, of equal manual ones the first by ``at``."""
    key = F.lower(F.trim("title"))
    new = manual.withColumn("_key", key).where("_key <> ''").join(extracted.select(key.alias("_key")), "_key", "left_anti")
    first = new.groupBy("_key").agg(F.min_by(F.struct("title", "date"), F.struct("at", "title")).alias("r"))
    added = first.select("r.title", "r.date", F.lit(confidence).alias("confidence"))
    return extracted.select("title", "date", "confidence").unionByName(added).orderBy(F.desc("confidence"), F.desc("date"), "title").limit(n)


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def required_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``; ValueError if two have equal keys. One job counts by key and stops at a hit."""
    bad = repeated_keys(rows, keys).head(1)
    if bad:
        raise ValueError(f"repeated key: {bad[0].asDict()}")
    return rows


NAME = r"[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?"
BYTE = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]|0[0-9][0-9])"
DOMAIN = rf"^({NAME}\.)+[A-Za-z]{{2,12}}$"
ADDRESS = rf"^({BYTE}\.){{3}}{BYTE}$"


def canonical_url(text: Column) -> Column:
    """A text as an address: what has a scheme stays, a host gets one, all else is null."""
    t = F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Cntrl}\u200b\ufeff]+|[\s\p{Cntrl}\u200b\ufeff]+$", ""), r"\.+$", "")
    host = F.regexp_extract(t, r"^([^/?#:]*)", 1)
    local = (F.lower(host) == "localhost") | host.rlike(ADDRESS)
    bare = F.regexp_replace(t, "/+$", "")
    return (
        F.when((t == "") | F.contains(t, F.lit(" ")), None)
        .when(F.contains(t, F.lit("://")) | F.lower(t).rlike("^(about|chrome|edge|file):"), t)
        .when(local, F.concat(F.lit("http://"), bare))
        .when(host.rlike(DOMAIN), F.concat(F.lit("https://"), bare))
    )


def page_hint(title: Column) -> Column:
    """An address in a window title: its first word, else its `` - `` parts from the right. A host with a
    path glued to it is none."""
    parts = F.reverse(F.split(title, " - "))
    words = F.concat(F.array(F.get(F.split(F.trim(title), r"\s+"), F.lit(0))), F.transform(parts, F.trim))
    return F.get(F.filter(F.transform(words, canonical_url), lambda u: u.isNotNull() & ~apps.is_merged_domain(u)), F.lit(0))


def report_keywords(rows: DataFrame, keys: list[str], title: str, body: str, order: list[str], n: int = 30) -> DataFrame:
    """Per group the first ``n`` different words in order of appearance: of each row at most
    three of the title and five of the body. Words are counted before rows meet in a group."""
    parts = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), r"[^\p{L}\p{N}_-]+")
    head = F.slice(F.filter(parts(title), lambda w: F.length(w).between(2, 30)), 1, 3)
    tail = F.slice(F.filter(parts(body), lambda w: F.length(w).between(2, 20) & w.rlike(r"^\p{L}+$")), 1, 5)
    words = rows.select(*keys, F.struct(*order).alias("_at"), F.posexplode(F.concat(head, tail)).alias("_pos", "word"))
    first = words.groupBy(*keys, "word").agg(F.min(F.struct("_at", "_pos")).alias("_first"))
    kept = top_by_group(first, keys, [F.col("_first")], n)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "word"))), lambda r: r["word"]).alias("words"))


def normal_query(text: Column, most_bytes: int = 32768, most: int = 8192) -> Column:
    """One kind of line end, no control characters, trimmed lines, runs of blank lines as one;
    null if nothing is left or too much."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    clean = F.array_join(F.transform(lines, lambda v: F.regexp_replace(F.regexp_replace(v, r"[\p{Cntrl}&&[^\t]]", ""), r"^\s+|\s+$", "")), "\n")
    out = F.regexp_replace(F.regexp_replace(clean, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when((out != "") & (F.octet_length(out) <= most_bytes) & (F.length(out) <= most), out)


def canonical_json(pairs: Column, allowed: list[str], most_bytes: int = 8192) -> Column:
    """A map of texts as JSON by key; null if a key isn't allowed or the JSON is too long."""
    known = F.size(F.array_except(F.map_keys(pairs), F.array(*map(F.lit, allowed)))) == 0
    out = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))
    return F.when(known & (F.octet_length(out) <= most_bytes), out)


def result_digest(hits: DataFrame, keys: list[str], parts: list[str], rank: str) -> DataFrame:
    """Per query a digest of its ranked hits. A query's hits are a top-k, so the list is bounded."""
    one = tx.prefixed_digest(*[F.col(p).cast("string") for p in parts])
    return hits.select(*keys, rank, one.alias("_d")).groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "_d"))), lambda r: r["_d"]), ""), 256).alias("digest"))


def still_true(receipts: DataFrame, chunks: DataFrame, key: str, content: str) -> DataFrame:
    """Receipts whose excerpt can be read again with the digest that was noted, with the text."""
    now = chunks.select(key, F.col(content).alias("excerpt"))
    return receipts.join(now, key).where(F.sha2("excerpt", 256) == F.col("digest")).drop("digest")


def idle(input_idle: Column, seconds: Column, screenshots: Column, hard_stop: int = 600) -> Column:
    """Idle past the hard stop always, before it only where no screenshot can tell."""
    return input_idle & ((seconds >= hard_stop) | ~screenshots)


def deleted(acts: DataFrame, reports: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """``acts`` without the rows of ``which``, and ``reports`` without the days that these touch."""
    days = acts.where(which).select(F.floor(F.col("end_ts") / 86400).alias("day")).distinct()
    return acts.where(~F.coalesce(which, F.lit(False))), reports.join(days, "day", "left_anti")


def markdown(reports: DataFrame, since: str, until: str) -> DataFrame:
    """One Markdown section a day inside the bounds; ``write.text`` in order of ``date`` exports it."""
    body = F.concat(F.lit("## "), "date", F.lit("\n\n"), F.trim("content"), F.lit("\n\n---\n"))
    return reports.where(F.col("date").between(since, until)).select("date", body.alias("section"))


def average_towards(current: Column, new: Column, weight: float = 0.3, lo: float = 0.0, hi: float = 1.0, least: float = 0.05) -> Column:
    """An exponential average kept inside bounds, that moves only by more than ``least``."""
    aim = F.least(F.lit(hi), F.greatest(F.lit(lo), current * (1 - weight) + new * weight))
    return F.when(F.abs(aim - current) > least, aim).otherwise(current)
