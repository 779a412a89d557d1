"""Statistics over interval records (see sources.tables.activities): each takes a frame and
returns one. ``owner`` is part of every key, so that no window holds all records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkact.functions import text as tx
from sparkact.functions.intervals import DAY, HOUR, attributed, clipped, covered, overlap, split

GAP = 900


def timeline(acts: DataFrame, lo: int, hi: int) -> DataFrame:
    """Newest record of each (owner, app, page) in [lo, hi), with the group's clipped seconds."""
    page = F.coalesce(tx.trimmed_url(F.col("url")), F.lit(""))
    by = clipped(acts, lo, hi).groupBy("owner", "app", page.alias("page"))
    newest = by.agg(F.max(F.struct("end_ts", "id")).alias("newest"), F.sum(F.col("e") - F.col("s")).alias("seconds"))
    return newest.select("newest.id", "newest.end_ts", "owner", "app", "page", "seconds")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def after(df: DataFrame, cursor: tuple[int, int], limit: int) -> DataFrame:
    """Keyset page: the records that follow (end_ts, id)."""
    ts, i = cursor
    return df.where((F.col("end_ts") > ts) | ((F.col("end_ts") == ts) & (F.col("id") > i))).orderBy("end_ts", "id").limit(limit)


def days(acts: DataFrame) -> DataFrame:
    return split(acts.withColumn("s", F.col("start_ts")).withColumn("e", F.col("end_ts")), DAY, "day")


def hours(acts: DataFrame) -> DataFrame:
    return split(acts.withColumn("s", F.col("start_ts")).withColumn("e", F.col("end_ts")), HOUR, "hour")


def day_totals(acts: DataFrame) -> DataFrame:
    return days(acts).groupBy("day").agg(F.sum(F.col("e") - F.col("s")).alias("seconds"), F.count_distinct("owner").alias("owners"))


def hourly_covered(acts: DataFrame) -> DataFrame:
    """Seconds of each hour that any record of an owner covers; overlaps count once."""
    return covered(hours(acts), ["owner", "hour"])


def hour_of_day(acts: DataFrame) -> DataFrame:
    """24 buckets over all days, zero-filled."""
    by_hour = hourly_covered(acts).groupBy(F.pmod("hour", F.lit(24)).alias("h")).agg(F.sum("seconds").alias("seconds"))
    every = acts.sparkSession.range(24).select(F.col("id").alias("h"))
    return every.join(F.broadcast(by_hour), "h", "left").select("h", F.coalesce("seconds", F.lit(0)).alias("seconds"))  # 24 rows


def hour_app_attribution(acts: DataFrame) -> DataFrame:
    return attributed(hours(acts), ["owner", "hour"], ["app"])


def usage(acts: DataFrame, key: str) -> DataFrame:
    """Seconds, records and rounded-down percent by ``key``."""
    by = acts.groupBy(key).agg(F.sum("duration").alias("seconds"), F.count("*").alias("n"))
    return by.withColumn("percent", F.floor(F.col("seconds") * 100 / F.greatest(F.sum("seconds").over(Window.partitionBy()), F.lit(1))).cast("long"))


def domain_usage(acts: DataFrame) -> DataFrame:
    d = acts.where("url is not null").groupBy(tx.host(F.col("url")).alias("domain"), tx.trimmed_url(F.col("url")).alias("page")).agg(F.sum("duration").alias("seconds"))
    return d.groupBy("domain").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("pages"))


def browser_rollup(acts: DataFrame) -> DataFrame:
    """Browser, domain and page totals in one pass; null stands for all."""
    rows = acts.where("url is not null").select(F.col("app").alias("browser"), tx.host(F.col("url")).alias("domain"), tx.trimmed_url(F.col("url")).alias("page"), "duration")
    return rows.rollup("browser", "domain", "page").agg(F.sum("duration").alias("seconds"))


def weighted_mode(df: DataFrame, keys: list[str], label: str, weight: str) -> DataFrame:
    """The label with the greatest total weight by key; ties go to the smallest label."""
    sums = df.groupBy(*keys, label).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("minus"), F.col(label).alias("label"))).alias("b"))
    return best.select(*keys, F.col("b.label").alias("mode"), (-F.col("b.minus")).alias("weight"))


def work_time(acts: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """Covered seconds a day inside segments of the day (seconds from midnight); a segment that
    ends before it starts runs past midnight. Overlapping segments count once."""
    cut = [x for a, b in segments for x in ([(a, b)] if a < b else [(a, DAY), (0, b)])]
    whole = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in cut])
    rows = days(acts).withColumn("g", F.explode(whole))
    base = F.col("day") * DAY
    inside = rows.select("owner", "day", F.greatest("s", base + F.col("g.a")).alias("s"), F.least("e", base + F.col("g.b")).alias("e")).where("e > s")
    return covered(inside, ["owner", "day"], "work_seconds")


def overtime(acts: DataFrame, last_end: int) -> DataFrame:
    """Summed seconds a day from the last segment's end to midnight."""
    rows = days(acts)
    base = F.col("day") * DAY
    return rows.groupBy("day").agg(F.sum(overlap(F.col("s"), F.col("e"), base + last_end, base + DAY)).alias("overtime_seconds"))


def weeks(acts: DataFrame) -> DataFrame:
    """Weeks from Monday: day 0 of the epoch was a Thursday."""
    by = days(acts).withColumn("week", F.floor((F.col("day") + 3) / 7).cast("long"))
    return by.groupBy("week", "category").agg(F.sum(F.col("e") - F.col("s")).alias("seconds"), F.count_distinct("day").alias("active_days"))


def trend(acts: DataFrame, key: str, before: tuple[int, int], now: tuple[int, int]) -> DataFrame:
    """Two periods side by side in one pass: change in seconds and percent, new and vanished keys."""
    a, b = (overlap(F.col("start_ts"), F.col("end_ts"), *p) for p in (before, now))
    scan = acts.where((F.col("end_ts") > min(before[0], now[0])) & (F.col("start_ts") < max(before[1], now[1])))
    by = scan.groupBy(key).agg(F.sum(a).alias("old"), F.sum(b).alias("new")).where("old + new > 0")
    return by.withColumn("delta", F.col("new") - F.col("old")).withColumn("percent", F.when(F.col("old") > 0, F.round(F.col("delta") * 100.0 / F.col("old"), 4))).withColumn("state", F.when(F.col("old") == 0, "new").when(F.col("new") == 0, "gone").otherwise("both"))


def latest(acts: DataFrame, keys: list[str]) -> DataFrame:
    """The newest record by key, and the newest url that isn't null."""
    best = acts.groupBy(*keys).agg(F.max(F.struct("end_ts", "id", "category")).alias("x"), F.max(F.when(F.col("url").isNotNull(), F.struct("end_ts", "id", "url"))).alias("u"))
    return best.select(*keys, F.col("x.end_ts").alias("end_ts"), F.col("x.id").alias("id"), F.col("x.category").alias("category"), F.col("u.url").alias("url"))


def heavy(acts: DataFrame, keys: list[str], least: int, limit: int) -> DataFrame:
    """Keys with at least ``least`` seconds, the ``limit`` greatest first."""
    return acts.groupBy(*keys).agg(F.sum("duration").alias("seconds")).where(F.col("seconds") >= least).orderBy(F.desc("seconds"), *keys).limit(limit)


def sessions(acts: DataFrame, gap: int = GAP) -> DataFrame:
    """Records with a session number by owner: a new one starts where a record, taken to last a
    second at least, starts more than ``gap`` after the end of the one before."""
    w = Window.partitionBy("owner").orderBy("end_ts", "id")
    length = F.greatest("duration", F.lit(1))
    new = F.coalesce((F.col("end_ts") - length - F.lag("end_ts").over(w) > gap).cast("int"), F.lit(1))
    return acts.withColumn("length", length).withColumn("new", new).withColumn("session", F.sum("new").over(w)).drop("new")


def session_table(acts: DataFrame, gap: int = GAP) -> DataFrame:
    s = sessions(acts, gap)
    first = F.min(F.struct("end_ts", "id", (F.col("end_ts") - F.col("length")).alias("start")))
    return s.groupBy("owner", "session").agg(first.alias("f"), F.max("end_ts").alias("end_ts"), F.sum("length").alias("seconds"), F.count("*").alias("n"), F.count_distinct("app").alias("apps")).select("owner", "session", F.col("f.start").alias("start_ts"), "end_ts", "seconds", "n", "apps")


def session_top(acts: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` apps with most seconds of each session; ties by name."""
    by = sessions(acts).groupBy("owner", "session", "app").agg(F.sum("length").alias("seconds"))
    return top_by_group(by, ["owner", "session"], [F.desc("seconds"), F.asc("app")], n)


def top_by_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


INTENTS = (("development", "error"), ("shopping", "purchase"), ("onboarding", "signup"), ("browsing", "view click"))


def intents(acts: DataFrame) -> DataFrame:
    """Sessions by what most of their records say: 10 points a record, ties by label."""
    label = F.expr("CASE " + " ".join(f"WHEN app IN ({', '.join(repr(a) for a in apps.split())}) THEN '{name}'" for name, apps in INTENTS) + " ELSE 'other' END")
    score = sessions(acts).withColumn("intent", label).withColumn("points", F.lit(10))
    mode = weighted_mode(score, ["owner", "session"], "intent", "points")
    totals = sessions(acts).groupBy("owner", "session").agg(F.sum("length").alias("seconds"))
    return mode.join(totals, ["owner", "session"]).groupBy(F.col("mode").alias("intent")).agg(F.count("*").alias("sessions"), F.sum("seconds").alias("seconds"))


def weekly_review(acts: DataFrame, deep: int = 300, switches: int = 2) -> DataFrame:
    """Key figures by week: sessions, deep and switching ones, active days, the busiest day."""
    t = session_table(acts).withColumn("day", F.floor(F.col("start_ts") / DAY).cast("long")).withColumn("week", F.floor((F.col("day") + 3) / 7).cast("long"))
    by_day = t.groupBy("week", "day").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"), F.count_if(F.col("seconds") >= deep).alias("deep"), F.count_if(F.col("apps") >= switches).alias("switching"))
    return by_day.groupBy("week").agg(F.sum("n").alias("sessions"), F.sum("deep").alias("deep"), F.sum("switching").alias("switching"), F.count("*").alias("active_days"), F.max(F.struct("seconds", (-F.col("day")).alias("minus"))).alias("b")).select("week", "sessions", "deep", "switching", "active_days", (-F.col("b.minus")).alias("busiest_day"), F.col("b.seconds").alias("busiest_seconds"))


def peak_hours(acts: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` hours of the day with most covered seconds; 24 rows are ranked."""
    return hour_of_day(acts).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("seconds"), "h"))).where(F.col("rank") <= n)


def active_runs(acts: DataFrame, least: int = 1) -> DataFrame:
    """Longest run of consecutive active hours by owner and day: islands on hour minus rank."""
    active = hourly_covered(acts).where(F.col("seconds") >= least).withColumn("day", F.floor(F.col("hour") / 24).cast("long"))
    island = F.col("hour") - F.row_number().over(Window.partitionBy("owner", "day").orderBy("hour"))
    runs = active.withColumn("island", island).groupBy("owner", "day", "island").agg(F.count("*").alias("length"), F.min("hour").alias("first"))
    return runs.groupBy("owner", "day").agg(F.max(F.struct("length", (-F.col("first")).alias("minus"))).alias("b")).select("owner", "day", F.col("b.length").alias("length"), (-F.col("b.minus")).alias("first_hour"))


def hour_stats(acts: DataFrame, cap: int = 5) -> DataFrame:
    """By owner and hour: records, seconds, app changes, and the first ``cap`` different pages in order."""
    rows = acts.withColumn("hour", F.floor(F.col("end_ts") / HOUR).cast("long"))
    w = Window.partitionBy("owner", "hour").orderBy("end_ts", "id")
    change = F.coalesce((F.lag("app").over(w) != F.col("app")).cast("int"), F.lit(0))
    seen = F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("end_ts", "id", "url"))))
    by = rows.withColumn("change", change).groupBy("owner", "hour").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"), F.sum("change").alias("changes"), seen.alias("seen"))
    return by.select("owner", "hour", "n", "seconds", "changes", F.array_join(F.slice(F.array_distinct(F.transform("seen", lambda x: x["url"])), 1, cap), "|").alias("pages"))


def insights(acts: DataFrame, share: float = 0.25) -> DataFrame:
    """Days on which a category other than development takes more than ``share`` of the time."""
    by = days(acts).groupBy("day", "category").agg(F.sum(F.col("e") - F.col("s")).alias("seconds"))
    part = F.col("seconds") / F.sum("seconds").over(Window.partitionBy("day"))
    return by.withColumn("part", part).where((F.col("category") != "development") & (F.col("part") > share)).select("day", "category", "seconds", F.round("part", 6).alias("share"))


def merged_captures(acts: DataFrame, gap: int = 600) -> DataFrame:
    """Batch form of the capture merge: runs of one app whose records follow within ``gap`` are one."""
    w = Window.partitionBy("owner").orderBy("end_ts", "id")
    new = (F.lag("app").over(w).isNull() | (F.lag("app").over(w) != F.col("app")) | (F.col("end_ts") - F.lag("end_ts").over(w) > gap)).cast("int")
    return acts.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("owner", "run", "app").agg(F.sum("duration").alias("seconds"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n"))


def retained(acts: DataFrame, newest: int) -> DataFrame:
    """The ``newest`` last records of each owner."""
    return top_by_group(acts, ["owner"], [F.desc("end_ts"), F.desc("id")], newest).drop("rank")
