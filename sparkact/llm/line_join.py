"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line goes if a line before it, in the order of (doc_id, position), is within ``edits`` edit
operations. Lines under ``least`` characters go only if they equal a line before and have
``exact`` characters at least (``exact`` is ``least`` unless given: they are left alone then).
Lines are what stands between newlines.

Texts are dealt by doc_id once, into a bucketed table; after that only digests, keys and
positions are shuffled. Lines are equal if their lengths and two 64-bit digests are, and each
stands for its copies under the place where it stands first. Each such line is split into
``edits + 1`` segments, one of which any line within reach holds unchanged: segments are indexed
by (length, number, hash), and every line probes the indexes of its own and the slightly smaller
lengths with the substrings at the few positions where a segment can have moved to (the
multi-match-aware choice). Of the pairs that meet, those are left that share all but ``edits`` of
a finer split too, and are verified by a banded bit-parallel edit distance: the 2 * edits + 1
cells around the diagonal are bits of one integer, advanced a column at a time.

A key that more than FEW lines hold makes no pairs. For one edit, the part of the line that the
key leaves open is split again into PARTS ranges, and the lines meet anew under keys of all that
lies outside one range, until a range is one character: then all lines of a key are within reach
of its first, so that its pairs are as many as its lines. The number of pairs so grows with the
lines, whatever they share. For more edits than one such keys are compared pair by pair.

Defined results: a null text stays null and has no lines; an empty text is one empty line. Rows
without a doc_id are left alone; rows of one doc_id are copies of one document. A document of
which no line is left has an empty text. Extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkact.llm.common import release, shared_dir, shuffle_partitions, written

FEW = 16  # lines of one key that are compared with each other
PARTS = 8  # ranges that the open part of a hot key's lines is split into


def segment(length: Column, number: int, edits: int) -> tuple[Column, Column]:
    """(start from 0, size) of a segment of a line; the last ones are longer by one if need be."""
    parts = edits + 1
    base, rest = F.floor(length / parts), length % parts
    return (number * base + F.greatest(F.lit(0), number - (parts - rest))).cast("int"), (base + F.when(F.lit(number) >= parts - rest, 1).otherwise(0)).cast("int")


def key(length: Column, number: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(number), F.substring(F.col("line"), start + 1, size))


def keys(edits: int) -> Column:
    """Keys of a line as array<struct<key, longer, number>>: what it is indexed by (longer is 0),
    and what it looks up otherwise, in the index of lines shorter by ``longer`` characters. Lines
    of one length whose segment has not moved meet in the index itself."""
    out = []
    for shorter in range(edits + 1):
        length = F.col("size") - shorter
        for i in range(edits + 1):
            start, size = segment(length, i, edits)
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                at = start + shift
                fits = (at >= 0) & (at + size <= F.col("size"))
                probe = shorter > 0 or shift != 0
                out.append(F.struct(F.when(fits, key(length, i, at, size)).alias("key"), F.lit(shorter if shorter or not probe else -1).cast("byte").alias("longer"), F.lit(i).cast("byte").alias("number")))
    return F.filter(F.array(*out), lambda k: k["key"].isNotNull())


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def banded_distance(x: Column, y: Column, edits: int) -> Column:
    """The edit distance of two lines whose lengths differ by ``edits`` at most and are greater
    than that; exact where it is ``edits`` or less."""
    width = 2 * edits + 1
    full, top = (1 << width) - 1, width - 1
    bits = lambda v: F.lit(v).cast("long")
    inverted = lambda v: v.bitwiseXOR(bits(full))

    def run(a: Column, b: Column) -> Column:
        def column(state: Column, j: Column) -> Column:
            mine = F.get(b, j - 1)
            hits = None
            for bit in range(width):  # the bit stands for row j - edits + bit
                hit = F.when((j + (bit - edits) >= 1) & (F.get(a, F.greatest(j + (bit - edits - 1), F.lit(0))) == mine), bits(1 << bit)).otherwise(bits(0))
                hits = hit if hits is None else hits + hit

            def advance(v: Column) -> Column:
                vp, vn, d0 = state["vp"], state["vn"], v
                hp = vn.bitwiseOR(inverted(d0.bitwiseOR(vp)))
                hn = d0.bitwiseAND(vp)
                moved = F.shiftright(d0, 1)
                row = F.size(a) - j + edits  # the bit of the last row, once it is inside the band
                bit_of = lambda z, at: F.call_function("shiftright", z, at.cast("int")).bitwiseAND(bits(1))
                step = F.when(row >= top, bits(1) - F.shiftright(d0, top).bitwiseAND(bits(1))).otherwise(bit_of(hp, row) - bit_of(hn, row))
                return F.struct(
                    hn.bitwiseOR(inverted(moved.bitwiseOR(hp))).alias("vp"), moved.bitwiseAND(hp).alias("vn"), (state["distance"] + step).alias("distance")
                )

            def diagonal(h: Column) -> Column:
                sums = (h.bitwiseAND(state["vp"]) + state["vp"]).bitwiseAND(bits(full))
                return sums.bitwiseXOR(state["vp"]).bitwiseOR(h).bitwiseOR(state["vn"])

            return let(let(hits, diagonal), advance)

        begin = F.struct(bits(full >> edits << edits).alias("vp"), bits(0).alias("vn"), bits(edits).alias("distance"))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), begin, column, lambda s: s["distance"])

    return let(F.split(x, ""), lambda a: let(F.split(y, ""), lambda b: run(a, b)))


def shares_enough(x: Column, y: Column, edits: int) -> Column:
    """Whether ``y`` holds all but ``edits`` of the segments of a finer split of ``x``, each moved
    by ``edits`` places at most. True of any two lines within reach, as an edit breaks one segment."""
    parts, found = 4 * (edits + 1), F.lit(0)
    for i in range(parts):
        start, size = segment(F.length(x), i, parts - 1)
        own, same = F.substring(x, start + 1, size), F.lit(False)
        for shift in (0, *range(-edits, 0), *range(1, edits + 1)):
            same = same | ((start + shift >= 0) & (F.substring(y, start + shift + 1, size) == own))
        found = found + F.when(same, 1).otherwise(0)
    return found >= parts - edits


def dealt(docs: DataFrame) -> DataFrame:
    """d (the doc_id) and row (all columns) of the rows with a doc_id, as a table in buckets of d
    in the shared folder: joins with small frames by d then leave the texts where they are."""
    spark = docs.sparkSession
    n, name = shuffle_partitions(spark), f"dealt_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    held = docs.where("doc_id is not null").select(F.col("doc_id").alias("d"), F.struct("*").alias("row"))
    held.repartition(n, "d").write.bucketBy(n, "d").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.table(name).select("d", "row")
    out.schema  # noqa: B018  resolved now: the frame knows path and buckets, and the catalogue needs no entry
    spark.sql(f"DROP TABLE {name}")  # a table with a path of its own: the files stay
    return out


def split(text: Column | str) -> Column:
    return F.split(text, "\n")


def by_document(places: DataFrame) -> DataFrame:
    """d, ps: the positions of a document in ascending order."""
    return places.groupBy("d").agg(F.sort_array(F.collect_set("p")).alias("ps"))


def first_lines(held: DataFrame, exact: int) -> DataFrame:
    """(d, ps) of the lines of ``exact`` characters and more that equal no line before."""
    place = F.col("d").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("p")
    every = held.select("d", F.posexplode(split("row.text")).alias("p", "line")).where(F.length("line") >= exact)
    digests = (F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("size"))
    firsts = every.select(*digests, place.alias("place")).groupBy("h1", "h2", "size").agg(F.min("place").alias("place"))
    d = F.floor(F.col("place") / F.lit(1 << 32).cast("decimal(10,0)"))
    return by_document(firsts.select(d.cast("long").alias("d"), (F.col("place") - d * F.lit(1 << 32).cast("decimal(10,0)")).cast("int").alias("p")))


def texts(held: DataFrame, places: DataFrame) -> DataFrame:
    """(d, p, line) of the places (d, ps)."""
    found = let(split("row.text"), lambda ls: F.transform("ps", lambda p: F.struct(p.alias("p"), F.get(ls, p).alias("line"))))
    return held.join(places.hint("shuffle_hash"), "d").select("d", F.explode(found).alias("x")).select("d", "x.p", "x.line").where("line is not null")


def shared_keys(rows: DataFrame) -> DataFrame:
    """The rows (d, p, key, longer, ...) whose key joins an indexed line with another row, and
    how many rows the key has."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.abs("longer")).alias("least")).where("n > 1 AND least = 0")
    return rows.join(sizes.drop("least"), "key")


def pairs(few: DataFrame) -> DataFrame:
    """(ad, ap, bd, bp): each two lines that meet under a key."""
    x = few.where("longer = 0").select("key", F.col("d").alias("ad"), F.col("p").alias("ap"))
    y = few.select("key", F.col("d").alias("bd"), F.col("p").alias("bp"), "longer")
    a, b = F.struct("ad", "ap"), F.struct("bd", "bp")
    return x.join(y, "key").where((a < b) | (F.col("longer") != 0) & (a != b)).select("ad", "ap", "bd", "bp")


def pairs_with_first(rows: DataFrame) -> DataFrame:
    """The first indexed line of each key with its others."""
    own = rows.where("longer = 0")
    first = own.groupBy("key").agg(F.min(F.struct("d", "p")).alias("a"))
    return own.join(first, "key").where(F.col("a") != F.struct("d", "p")).select(F.col("a.d").alias("ad"), F.col("a.p").alias("ap"), F.col("d").alias("bd"), F.col("p").alias("bp"))


def finer(hot: DataFrame) -> DataFrame:
    """The rows (d, p, longer, from, to, line) of hot keys under keys of all that lies outside one
    of the ranges that [from, to) is split into; of one character, under the whole shorter line."""
    m, n, longer = F.col("to") - F.col("from"), F.length("line") - F.col("longer"), F.col("longer")
    cut = lambda i: (F.col("from") + F.floor(m * i / F.least(m, F.lit(PARTS)))).cast("int")
    outside = lambda s, e: F.xxhash64(n, s, e, F.substring("line", F.lit(1), s), F.substring("line", e + longer + 1, F.length("line")))
    row = lambda k, s, e: F.struct(k.alias("key"), s.alias("from"), e.alias("to"))
    ranges = F.array(*[F.when(m > i, row(outside(cut(i), cut(i + 1)), cut(i), cut(i + 1))) for i in range(PARTS)])
    without = lambda at: row(F.xxhash64(F.lit(-1), F.concat(F.substring("line", F.lit(1), at), F.substring("line", at + longer + 1, F.length("line")))), F.lit(0), F.lit(0))
    ends = F.array(without(F.col("from")), F.when(longer > 0, without(F.col("from") + 1)))
    return hot.select("d", "p", "longer", F.explode(F.filter(F.when(m > 1, ranges).otherwise(ends), lambda x: x.isNotNull())).alias("x")).select("d", "p", "longer", "x.*").distinct()


def near_pairs(held: DataFrame, firsts: DataFrame, edits: int, least: int) -> DataFrame:
    """(ad, ap, bd, bp): places of different lines within ``edits`` edit operations, each pair once,
    but of a hot key's lines only those with its first line where all are within reach of it."""
    lines = texts(held, firsts).withColumn("size", F.length("line")).where(F.col("size") >= least)
    rows = written(lines.select("d", "p", F.explode(keys(edits)).alias("k")).select("d", "p", "k.key", "k.longer", "k.number"), "line-keys")
    live = written(shared_keys(rows), "line-live")
    release(held.sparkSession)
    found = [pairs(live.where(F.col("n") <= FEW) if edits == 1 else live)]
    hot = live.where(F.col("n") > FEW)
    if edits == 1 and not hot.isEmpty():
        hot_lines = written(texts(held, by_document(hot.select("d", "p"))), "line-hot")
        size = F.length("line") - F.col("longer")
        start, own = segment(size, 0, edits)[1], F.col("number") == 0
        hot = hot.join(hot_lines, ["d", "p"]).select("d", "p", "longer", F.when(own, start).otherwise(0).alias("from"), F.when(own, size).otherwise(start).alias("to"), "line")
        while hot is not None:
            live = written(shared_keys(finer(hot)), "line-live")
            found += [pairs(live.where((F.col("n") <= FEW) | (F.col("to") == F.col("from")))), pairs_with_first(live.where((F.col("n") > FEW) & (F.col("to") - F.col("from") == 1)))]
            more = live.where((F.col("n") > FEW) & (F.col("to") > F.col("from")))
            hot = None if more.isEmpty() else more.join(hot_lines, ["d", "p"])
    met = found[0]
    for f in found[1:]:
        met = met.unionByName(f)
    met = written(met.distinct(), "line-pairs")
    places = met.select(F.col("ad").alias("d"), F.col("ap").alias("p")).unionByName(met.select(F.col("bd").alias("d"), F.col("bp").alias("p")))
    own = written(texts(held, by_document(places)), "line-texts")
    x, y = (own.select(F.col("d").alias(f"{s}d"), F.col("p").alias(f"{s}p"), F.col("line").alias(t)) for s, t in ("ax", "by"))
    both = met.join(x, ["ad", "ap"]).join(y, ["bd", "bp"])
    shorter, longer_ = F.when(F.length("x") <= F.length("y"), F.col("x")).otherwise(F.col("y")), F.when(F.length("x") <= F.length("y"), F.col("y")).otherwise(F.col("x"))
    return both.select("ad", "ap", "bd", "bp", shorter.alias("x"), longer_.alias("y")).where(shares_enough(F.col("x"), F.col("y"), edits) & (banded_distance(F.col("x"), F.col("y"), edits) <= edits)).select("ad", "ap", "bd", "bp")


def judged(docs: DataFrame, edits: int, least: int, exact: int) -> DataFrame:
    """row (all columns of ``docs``), kept (the text of the lines that stay), n_lines, n_removed, and
    n_near: how many of the removed ones differ from all lines before."""
    held = dealt(docs)
    release(docs.sparkSession)
    firsts = written(first_lines(held, exact), "line-firsts")
    release(docs.sparkSession)
    late = F.greatest(F.struct(F.col("ad").alias("d"), F.col("ap").alias("p")), F.struct(F.col("bd").alias("d"), F.col("bp").alias("p")))
    near = written(by_document(near_pairs(held, firsts, edits, least).select(late.alias("x")).select("x.*")), "line-near")
    release(docs.sparkSession)
    none = F.array().cast("array<int>")
    marked = held.join(firsts.hint("shuffle_hash"), "d", "left").join(near.withColumnRenamed("ps", "late").hint("shuffle_hash"), "d", "left")
    first, late = F.coalesce("ps", none), F.coalesce("late", none)
    short = lambda ls: F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda p: F.length(F.get(ls, p)) < exact)
    stay = lambda ls: F.sort_array(F.concat(F.array_except(first, late), short(ls)))
    result = lambda ls: F.struct(F.size(ls).alias("n"), F.filter(F.transform(stay(ls), lambda p: F.get(ls, p)), lambda x: x.isNotNull()).alias("ls"))
    done = marked.select("row", F.size(late).alias("near"), F.when(F.col("row.text").isNotNull(), let(split("row.text"), result)).alias("done"))
    count = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    named = done.select("row", F.array_join("done.ls", "\n").alias("kept"), count(F.col("done.n")).alias("n_lines"), count(F.col("done.n") - F.size("done.ls")).alias("n_removed"), F.when(F.col("done").isNull(), 0).otherwise(F.col("near")).cast("long").alias("n_near"))
    alone = docs.where("doc_id is null").select(F.struct("*").alias("row"))
    zero = F.lit(0).cast("long")
    return named.unionByName(alone.select("row", F.col("row.text").alias("kept"), count(F.size(split("row.text"))).alias("n_lines"), zero.alias("n_removed"), zero.alias("n_near")))


def deduplicated(docs: DataFrame, edits: int = 1, least: int = 32, exact: int | None = None) -> DataFrame:
    """``docs``, all columns as they are but the text: the lines that stay."""
    done = judged(docs, edits, least, least if exact is None else min(exact, least))
    return done.select(*[F.col("kept").alias(n) if n == "text" else F.col("row").getField(n).alias(n) for n in docs.columns])


def removal_report(docs: DataFrame, edits: int = 1, least: int = 32, exact: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, kept_sha256 of each document."""
    done = judged(docs.select("doc_id", "text"), edits, least, least if exact is None else min(exact, least))
    return done.select("row.doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
