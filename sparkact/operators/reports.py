"""Daily reports, drill-downs and index maintenance over interval records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkact.functions import localtime
from sparkact.functions import text as tx
from sparkact.functions.intervals import attributed
from sparkact.operators.activity import hours


def local_days(acts: DataFrame, zone: str) -> DataFrame:
    """Seconds by owner and local date; a record is cut at local midnights, of days of any length."""
    last = F.col("end_ts") - 1
    rows = acts.where("end_ts > start_ts").withColumn("day", F.explode(F.sequence(F.to_date(localtime.local(F.col("start_ts"), zone)), F.to_date(localtime.local(last, zone)))))
    lo, hi = (localtime.epoch_of(d.cast("timestamp_ntz"), zone) for d in (F.col("day"), F.date_add("day", 1)))
    part = F.least("end_ts", hi) - F.greatest("start_ts", lo)
    return rows.groupBy("owner", F.col("day").cast("string").alias("date")).agg(F.sum(part).alias("seconds"))


def hour_app_range(acts: DataFrame) -> DataFrame:
    """The hour-by-app attribution of all days, merged by hour of day."""
    by = attributed(hours(acts), ["owner", "hour"], ["app"])
    return by.groupBy("owner", F.pmod("hour", F.lit(24)).alias("h"), "app").agg(F.sum("seconds").alias("seconds"))


def flexible_overtime(worked: DataFrame, seconds: str, standard_hours: float) -> DataFrame:
    """Overtime where working hours are free: what exceeds the standard."""
    return worked.withColumn("overtime_seconds", F.greatest(F.lit(0), F.col(seconds) - round(standard_hours * 3600)).cast("long"))


def daily_documents(acts: DataFrame) -> DataFrame:
    """One nested document a day and owner: total, apps (greatest first) and their urls."""
    day = F.floor(F.col("end_ts") / 86400).cast("long").alias("day")
    urls = acts.groupBy("owner", day, "app", "url").agg(F.sum("duration").alias("seconds"), F.count("*").alias("n"))
    apps = urls.groupBy("owner", "day", "app").agg(
        F.sum("seconds").alias("seconds"), F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct((-F.col("seconds")).alias("order"), "url", "seconds")))).alias("urls"),
    )
    return apps.groupBy("owner", "day").agg(F.sum("seconds").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("seconds")).alias("order"), "app", "seconds", "n", "urls"))).alias("apps"))


def without(documents: DataFrame, hidden: Column, hidden_url: Column | None = None) -> DataFrame:
    """Nested documents without the apps (and urls) that are hidden, their totals summed anew.
    ``hidden`` and ``hidden_url`` are functions of an app's or a url's struct."""
    kept = F.filter("apps", lambda a: ~hidden(a))
    if hidden_url is not None:
        kept = F.transform(kept, lambda a: a.withField("urls", F.filter(a["urls"], lambda u: ~hidden_url(u))))
    total = F.aggregate("apps", F.lit(0).cast("long"), lambda s, a: s + a["seconds"])
    return documents.withColumn("apps", kept).withColumn("total", total)


def drill_down(acts: DataFrame, category: str, title: Column, n: int = 60) -> DataFrame:
    """Of one category: seconds by app, and the title of its first record, cut."""
    rows = acts.where(F.col("category") == category).withColumn("title", F.substring(title, 1, n))
    return rows.groupBy("app").agg(F.sum("duration").alias("seconds"), F.min_by("title", F.struct("end_ts", "id")).alias("first_title"))


def app_summary(timeline: DataFrame, top: int = 15) -> DataFrame:
    """Seconds by app over a collapsed timeline, with whole percents; the ``top`` greatest."""
    by = timeline.groupBy("app").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("pages"))
    whole = F.sum("seconds").over(Window.partitionBy())  # a row an app
    return by.withColumn("percent", F.floor(F.col("seconds") * 100 / F.greatest(whole, F.lit(1))).cast("long")).orderBy(F.desc("seconds"), "app").limit(top)


def by_browser(acts: DataFrame, browser: Column | str = "app") -> DataFrame:
    """Seconds by domain and browser, and under ``other`` what no browser accounts for: records whose ``browser`` is null."""
    browser = F.col(browser) if isinstance(browser, str) else browser
    host = F.lower(tx.host(F.col("url")))
    total = acts.where("url is not null").groupBy(host.alias("domain")).agg(F.sum("duration").alias("total"))
    own = acts.where(F.col("url").isNotNull() & browser.isNotNull()).groupBy(host.alias("domain"), browser.alias("browser")).agg(F.sum("duration").alias("seconds"))
    rest = total.join(own.groupBy("domain").agg(F.sum("seconds").alias("known")), "domain", "left").select("domain", F.lit("other").alias("browser"), (F.col("total") - F.coalesce("known", F.lit(0))).alias("seconds"))
    return own.unionByName(rest.where("seconds > 0"))


def top_urls(acts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` urls of most time, each with the page count of its domain over all urls."""
    by = acts.where("url is not null").groupBy(tx.trimmed_url(F.col("url")).alias("url")).agg(F.sum("duration").alias("seconds")).withColumn("domain", tx.host(F.col("url")))
    pages = by.groupBy("domain").agg(F.count("*").alias("pages"))
    return by.orderBy(F.desc("seconds"), "url").limit(n).join(pages, "domain").select("url", "seconds", "domain", "pages")


def memory_chunks(acts: DataFrame, title: Column, content: Column, most: int = 1200, titles: int = 5) -> DataFrame:
    """Chunks for an index, one by date, app and domain (or the title's start): the longest
    content (the latest of equally long ones), the first distinct titles, the newest record."""
    date = F.floor(F.col("end_ts") / 86400).cast("long")
    place = F.coalesce(tx.host(F.col("url")), F.substring(title, 1, 80))
    rows = acts.select("id", "end_ts", date.alias("date"), "app", place.alias("place"), title.alias("title"), content.alias("content"))
    first = rows.groupBy("date", "app", "place", "title").agg(F.min("id").alias("at"), F.max("id").alias("last"), F.max(F.struct(F.length("content").alias("n"), "id", "content")).alias("best"))
    by = first.groupBy("date", "app", "place").agg(F.array_sort(F.collect_list(F.struct("at", "title"))).alias("titles"), F.max("last").alias("last_id"), F.max("best").alias("best"))
    names = F.array_join(F.transform(F.slice("titles", 1, titles), lambda t: t["title"]), " | ")
    return by.select("date", "app", "place", names.alias("titles"), F.substring("best.content", 1, most).alias("content"), "last_id")


def keep_longest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of (keys, content, vector): the longer content stays, the old one of equally long
    ones; a changed content has no vector until it is embedded anew."""
    both = old.select(*keys, "content", "vector", F.lit(0).alias("age")).unionByName(new.select(*keys, "content", F.lit(None).cast(old.schema["vector"].dataType).alias("vector"), F.lit(1).alias("age")))
    best = both.groupBy(*keys).agg(F.max_by(F.struct("content", "vector"), F.struct(F.length("content"), -F.col("age"))).alias("x"))
    return best.select(*keys, "x.content", "x.vector")


def embedding_queue(chunks: DataFrame, after: str, n: int = 32) -> DataFrame:
    """The next chunks without a vector, in the order of their keys."""
    return chunks.where(F.col("vector").isNull() & (F.col("chunk_key") > after)).orderBy("chunk_key").limit(n)


def missing_urls(acts: DataFrame, since: int, n: int) -> DataFrame:
    return acts.where((F.coalesce("url", F.lit("")) == "") & (F.col("end_ts") >= since)).orderBy(F.desc("end_ts"), F.desc("id")).limit(n).select("id", "end_ts", "app")


def report_dates(acts: DataFrame, n: int) -> DataFrame:
    """The newest dates that have records, as ISO texts, which order as dates do."""
    return acts.select(F.date_from_unix_date(F.floor(F.col("end_ts") / 86400).cast("int")).cast("string").alias("date")).distinct().orderBy(F.desc("date")).limit(n)


def in_order(blocks: DataFrame, name: str, preferred: list[str]) -> DataFrame:
    """Blocks in the preferred order, then the others in their own (column ``at``)."""
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col(name))
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.when(place > 0, place).otherwise(1000 + F.col("at")))).cast("long"))  # few blocks


def coverage_gaps(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side: empty if both hold the same."""
    sides = wanted.select(*keys, F.lit(1).alias("side")).unionByName(there.select(*keys, F.lit(2).alias("side")))
    seen = sides.groupBy(*keys).agg(F.bit_or("side").alias("sides")).where("sides < 3")
    return seen.select(*keys, F.when(F.col("sides") == 1, "missing").otherwise("extra").alias("side"))


def backfilled(acts: DataFrame) -> DataFrame:
    """What a record of an app adds to the app before it, when an owner's app changes: the time
    between both, up to ten minutes, unless the owner was idle (no record for so long)."""
    w = Window.partitionBy("owner").orderBy("end_ts", "id")
    gap = F.col("start_ts") - F.lag("end_ts").over(w)
    rows = acts.select("owner", "id", "app", F.lag("app").over(w).alias("previous"), gap.alias("gap"))
    return rows.where((F.col("app") != F.col("previous")) & F.col("gap").between(1, 599))


def compact_duration(seconds: Column) -> Column:
    """1h 5m, 12m, 45s: the two greatest units."""
    h, m = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    whole = lambda x: x.cast("long").cast("string")
    long = F.when(m > 0, F.concat(whole(h), F.lit("h "), whole(m), F.lit("m"))).otherwise(F.concat(whole(h), F.lit("h")))
    return F.when(seconds >= 3600, long).when(seconds >= 60, F.concat(whole(m), F.lit("m"))).otherwise(F.concat(whole(seconds), F.lit("s")))


def percent_encoded(text: Column) -> Column:
    """Every byte but unreserved ones as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
