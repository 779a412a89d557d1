"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Level 1 encodes the listed keys; every later level encodes the keys of the level before
last that the last one lets through wrongly. Odd levels hold listed keys, even levels hold
keys of the corpus that are not listed. Levels are added until none of either kind is let
through wrongly, so that over the corpus's complete key universe the first level that
rejects a key tells its membership exactly (rejected by an odd level: not listed), without
a join at probing time. The first level has as many bits a key as make the keys that it lets
through wrongly about as many as the listed ones, whatever the universe's size; so all levels
together are smaller than the list itself, which the driver holds.

Keys of a url: every suffix of its host (cut at dots) followed by every prefix of its path
whose length is that of some rule's path.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and
the verdict ``allow``. Repeated rows are judged one by one. Empty tables give empty results. An
empty list rejects everything. Of equally long fitting rules, which are equal, ``block`` wins.
Extra columns stay, but those named host, path, rule or verdict give way to the results.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkact.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    bits: int
    hashes: int
    words: list[int]


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def member(self, key: Column) -> Column:
        """True where ``key``, one of the universe, is listed."""
        n = len(self.levels)
        out = F.lit(n % 2 == 1)  # passed all levels: decided by the last level's kind
        for i in range(n, 0, -1):
            out = F.when(passes(key, self.levels[i - 1], i), out).otherwise(F.lit(i % 2 == 0))
        return out


def bit_positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + h)), F.lit(bits)) for h in range(hashes)]


def passes(key: Column, level: Level, number: int) -> Column:
    """Whether all bits of ``key`` are set in ``level``; the words are one constant of the plan."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    out = F.lit(True)
    for p in bit_positions(key, number, level.bits, level.hashes):
        word = F.element_at(words, (F.floor(p / 64) + 1).cast("int"))
        bit = F.call_function("shiftleft", F.expr("1L"), F.pmod(p, F.lit(64)).cast("int"))
        out = out & (word.bitwiseAND(bit) != 0)
    return out


def encode(keys: DataFrame, count: int, number: int, bits_per_key: float, hashes: int) -> Level:
    """One level over the ``count`` distinct ``keys`` (column ``key``); its words reach the driver."""
    bits = max(64, ceil(count * bits_per_key / 64) * 64)
    rows = (
        keys.select(F.explode(F.array(*bit_positions(F.col("key"), number, bits, hashes))).alias("p"))
        .groupBy(F.floor(F.col("p") / 64).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.expr("1L"), F.pmod(F.col("p"), F.lit(64)).cast("int"))).alias("v"))
        .collect()
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r["w"]] = r["v"]
    return Level(bits, hashes, words)


def build(listed: DataFrame, universe: DataFrame, bits_per_key: float = 8, hashes: int = 3, many: int = 0) -> Cascade:
    """A cascade telling ``listed`` keys from the others in ``universe`` (both with a column
    ``key``). ``many``: about how many keys the universe has; the first level gets more bits and
    hashes than the others if these would let through more keys than are listed."""
    inside = listed.select("key").where("key is not null").distinct()
    cascade, total = Cascade(), inside.count()
    need = log2(max(2, many / max(1, total)))
    first = (max(bits_per_key, need / log(2)), max(hashes, ceil(need)) if need / log(2) > bits_per_key else hashes)
    # Level 1 meets the whole universe once; what it lets through wrongly is small from there on.
    count, held, other = total, inside, None
    while count:
        number = len(cascade.levels) + 1
        level = encode(held, count, number, *(first if number == 1 else (bits_per_key, hashes)))
        cascade.levels.append(level)
        if number == 1:
            let_in = universe.where("key is not null").where(passes(F.col("key"), level, 1)).select("key", F.lit(0).alias("is_listed"))
            other = written(let_in.unionByName(inside.withColumn("is_listed", F.lit(1))).groupBy("key").agg(F.max("is_listed").alias("is_listed")).where("is_listed = 0").select("key"), "cascade")
            held, other = other, held
        else:
            held, other = other.where(passes(F.col("key"), level, number)), held
        count = held.count()
    return cascade


RESULTS = ("host", "path", "rule", "verdict")


def judged(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url", **options) -> DataFrame:
    """``urls`` with host, path, rule and verdict. ``rules``: (allow or block, host followed by
    a path that starts with a slash); the longest fitting rule wins."""
    text = F.col("row").getField(url)
    after = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(F.col("after"), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.col("after"), r"^[^/?#]*([^?#]*)", 1)
    parsed = urls.select(F.struct("*").alias("row")).withColumn("after", F.coalesce(after, F.lit(""))).select("row", F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))
    lengths = sorted({len(r) - r.index("/") for _, r in rules})
    parts = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))) if lengths else F.array().cast("array<string>")
    keyed = parsed.withColumn("keys", keys)
    universe, many = keyed.select(F.explode("keys").alias("key")), 4 * len(lengths) * urls.count()
    fitting = [F.array().cast("array<struct<n: int, verdict: string, rule: string>>")]
    for verdict in ("allow", "block"):
        own = [F.lit(r) for v, r in rules if v == verdict]
        if own:
            listed = urls.sparkSession.range(1).select(F.explode(F.array(*own)).alias("key"))
            fitting.append(fits(F.col("keys"), build(listed, universe, many=many, **options), verdict))
    judged_ = keyed.withColumn("best", F.array_max(F.concat(*fitting)))
    kept = [F.col("row").getField(n).alias(n) for n in urls.columns if n not in RESULTS]
    return judged_.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def fits(keys: Column, cascade: Cascade, verdict: str) -> Column:
    """The listed ones of ``keys``, as (length, verdict, rule)."""
    return F.transform(F.filter(keys, cascade.member), lambda k: F.struct(F.length(k).alias("n"), F.lit(verdict).alias("verdict"), k.alias("rule")))
