"""Jaccard join on word shingles by T-occurrence search over inverted lists.

Two documents link if 100 * |x & y| >= percent * |x | y| for their sets of distinct shingles.

1. Inverted lists, by hash range: of the shingles in a quarter of the hash space, which stand
   in more than one document? A document that links has at most |x| * (100 - percent) / 100
   shingles that the other lacks, so one with more that stand nowhere else has no partner.
   Documents of equal sets form one class; its smallest doc_id stands for it from here on, and
   the same question is put again for the whole hash space, among these only.
2. T-occurrence search inside blocks of documents that share a shingle: a query's short lists
   are merged and counted, its longest are set aside and probed by binary search for the
   candidates that can still reach the overlap (DivideSkip). Blocks of any size are split;
   each part keeps the block's representative.
3. Whatever links lie across blocks: prefixes in order of list length (short lists first);
   lists whose documents are all in one component already need no search. A list of more than
   FEW documents is a block for the same search, split such that each two documents meet in a
   part. Of the shorter lists only pairs of different components are probed whose shingles
   behind the shared one suffice for the overlap, and whose parities differ in few enough
   places: a set's parities are those of the numbers of its shingles in PARITIES hash classes,
   and each place in which two sets differ is a shingle that only one of them has. Together
   this loses no link.

Defined results: a text without words (or null) has the empty set and is linked with nothing;
with fewer words than a shingle has, the whole sequence is its one shingle. Rows of one doc_id
are copies of one document. Rows without a doc_id have no component.
"""

from __future__ import annotations

from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkact.llm.common import broadcast_if_small, mix64, release, shuffle_partitions, written
from sparkact.llm.components import stars
from sparkact.llm.exchange import PACKED_DDL, all_of, exchanged, first_of_runs, record_batches, reduced, rows_of
from sparkact.llm.suffix_dedup import BASE2, Powers, chunks

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
QUARTER = np.uint64(1 << 62)
FLUSH = 4_000_000
RANGE = 5_000  # documents whose credits are summed together
FEW = 64  # documents of one prefix shingle that are compared as pairs; more are searched in blocks
WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: list[bytes], words: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the distinct shingle hashes of text i, ascending, are
    ``hashes[edges[i]:edges[i + 1]]``."""
    b = np.frombuffer(b" ".join([*(t.translate(LOWER) for t in texts), b""]), np.uint8)
    blank = SPACE[b]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    stop = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    up, down = powers.of(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    word = mix64((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(ends, start, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    # position i starts a shingle of as many words as its text has from there, up to ``words``,
    # unless shorter than both ``words`` and the text
    n = len(word)
    index = np.arange(n)
    left = (first + counts)[owner] - index if n else index
    keep = (left >= words) | ((index == first[owner]) if n else index.astype(bool))
    total = np.zeros(n, np.uint64)
    for k in range(words):
        m = max(0, n - k)
        total[:m] += np.where(left[:m] > k, word[k : k + m] * WEIGHTS[k], np.uint64(0))
    h = mix64(total + np.minimum(left, words).astype(np.uint64))[keep]
    who = owner[keep]
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    once = first_of_runs(who, h) if len(h) else np.zeros(0, bool)
    return h[once], np.searchsorted(who[once], np.arange(len(texts) + 1))


META = ["<i8", "<u4", "<u4", "<i8", "<i8"]
CREDIT = ["<i8", "<u4", "<u4"]
SEEN = "doc_id long, n long, nq long, h1 long, h2 long, shared long, late long"
SEEN_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in SEEN.split(", ")])


def lists(keys: list[np.ndarray], docs: list[np.ndarray], buckets: int, ranges: int):
    """Kind 0: (shingle, document, credited); kind 2: (document, how many of its shingles, and of
    these how many behind the first quarter, this task saw in another document too)."""
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    head = first_of_runs(key)
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, len(key)))
    common = np.repeat(sizes > 1, sizes)
    yield from credit_rows(*credits(key[common], doc[common]), ranges)
    yield from rows_of(0, key[head], [key[head], doc[head], (sizes > 1).astype("<u1")], buckets)


def credit_rows(who: np.ndarray, n: np.ndarray, late: np.ndarray, ranges: int):
    return rows_of(2, mix64(who.astype(np.uint64)), [who, n.astype("<u4"), late.astype("<u4")], ranges)


def credits(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, its entries, those behind the first quarter)."""
    who, at, n = np.unique(doc, return_inverse=True, return_counts=True)
    return who, n, np.bincount(at, key >= QUARTER, len(who)).astype(np.int64)


def map_lists(words: int, ranges: int):
    """Lists of the first quarter of the hash space; kind 1: facts of a document."""

    def task(batches, buckets):
        powers, keys, docs, n = Powers(), [], [], 0
        for rows in chunks(batches, 2):
            ids = np.array([r[0] for r in rows], np.int64)
            h, edges = shingle_sets([r[1] for r in rows], words, powers)
            size = np.diff(edges)
            who = np.repeat(np.arange(len(ids)), size)
            low = h < QUARTER
            digests = [xxhash.xxh3_128_intdigest(h[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            two = np.array([(d >> 64, d & (1 << 64) - 1) for d in digests], np.uint64).view(np.int64)
            yield from rows_of(1, mix64(ids.astype(np.uint64)), [ids, size.astype("<u4"), np.bincount(who[low], minlength=len(ids)).astype("<u4"), np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1])], ranges)
            keys.append(h[low])
            docs.append(ids[who[low]])
            n += len(keys[-1])
            if n >= FLUSH:
                yield from lists(keys, docs, buckets, ranges)
                keys, docs, n = [], [], 0
        if n:
            yield from lists(keys, docs, buckets, ranges)

    return task


def map_whole_lists(ranges: int):
    """Lists of the whole hash space, of rows (doc_id, shingles)."""

    def task(batches, buckets):
        keys, docs, n = [], [], 0
        for batch in batches:
            for doc, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(np.frombuffer(raw, "<u8"))
                docs.append(np.full(len(keys[-1]), doc))
                n += len(keys[-1])
                if n >= FLUSH:
                    yield from lists(keys, docs, buckets, ranges)
                    keys, docs, n = [], [], 0
        if n:
            yield from lists(keys, docs, buckets, ranges)

    return task


def reduce_lists(ranges: int):
    """Facts and credits, packed by document for :func:`reduce_credits`."""

    def task(held):
        rows = []
        if 1 in held:
            meta = all_of(held[1], META)
            rows.append(rows_of(1, mix64(meta[0].astype(np.uint64)), meta, ranges))
        if 2 in held:
            rows.append(credit_rows(*summed(held[2]), ranges))
        if 0 in held:
            key, doc, credited = all_of(held[0], ["<u8", "<i8", "<u1"])
            order = np.argsort(key, kind="stable")
            key, doc, credited = key[order], doc[order], credited[order]
            sizes = np.diff(np.append(np.flatnonzero(first_of_runs(key)), len(key)))
            found = np.repeat(sizes > 1, sizes) & (credited == 0)
            rows.append(credit_rows(*credits(key[found], doc[found]), ranges))
        yield from record_batches(chain.from_iterable(rows))

    return task


def summed(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Credits (document, n, late) of all payloads, one row a document; few are unpacked at a time."""
    who, n, late = np.zeros(0, "<i8"), np.zeros(0, "<u4"), np.zeros(0, "<u4")
    for at in range(0, len(payloads), 64):
        more = all_of(payloads[at : at + 64], CREDIT)
        ids, place = np.unique(np.concatenate([who, more[0]]), return_inverse=True)
        n, late = (np.bincount(place, np.concatenate(x), len(ids)).astype("<u4") for x in ((n, more[1]), (late, more[2])))
        who = ids
    return who, n, late


def reduce_credits(held):
    """A row for each document: its facts, if they were sent, and the sums of its credits."""
    who, n, late = summed(held.get(2, []))
    meta = all_of(held[1], META) if 1 in held else [who]
    ids, first = np.unique(meta[0], return_index=True)
    at = np.searchsorted(ids, who)
    sums = [np.bincount(at, x, len(ids)).astype(np.int64) for x in (n, late)]
    facts = [pa.array(m[first].astype(np.int64)) for m in meta[1:]] or [pa.nulls(len(ids), pa.int64())] * 4
    yield pa.RecordBatch.from_arrays([pa.array(ids), *facts, *map(pa.array, sums)], schema=SEEN_SCHEMA)


def listed(df: DataFrame, map_task, documents: int) -> DataFrame:
    """Both exchanges: by shingle, then by document; see SEEN. Documents are dealt to ranges by
    their number, not by that of the tasks: what a task sends is a row for each range that it has
    credits for."""
    ranges = -(-documents // RANGE) or 1
    return reduced(exchanged(df, map_task(ranges), reduce_lists(ranges), PACKED_DDL), reduce_credits, SEEN)


SETS = "doc_id long, n long, shingles binary"


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n and the sorted 64-bit shingle hashes of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def task(batches):
        powers = Powers()
        for rows in chunks(batches, 2):
            h, edges = shingle_sets([r[1] for r in rows], words, powers)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(np.diff(edges)), pa.array([h[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(task, SETS)


class Lists:
    """Inverted lists over the sets of one block, and the T-occurrence search in them."""

    SKIP = 0.0085  # of DivideSkip: how many lists are set aside, against the length of the longest

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.docs = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, self.starts = np.unique(tokens[order], return_index=True)
        self.stops = np.append(self.starts[1:], len(tokens))

    def linked(self, x: int) -> np.ndarray:
        """The documents of the block that link with document ``x``, itself left out."""
        n = int(self.sizes[x])
        need = -(-self.percent * n // 100)
        if not n:
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.tokens, self.sets[x])
        lengths = self.stops[at] - self.starts[at]
        at = at[np.argsort(lengths, kind="stable")]
        aside = min(need - 1, int(need / (self.SKIP * np.log2(max(2, lengths.max())) + 1)))
        short, long = at[: n - aside], at[n - aside :]
        merged = np.concatenate([self.docs[a:b] for a, b in zip(self.starts[short], self.stops[short], strict=True)])
        count = np.bincount(merged, minlength=len(self.sizes))
        found = np.flatnonzero((count >= need - aside) & (100 * np.minimum(self.sizes, n) >= self.percent * np.maximum(self.sizes, n)))
        found = found[found != x]
        overlap = count[found]
        for k, t in enumerate(long.tolist()):
            if not len(found):
                break
            inside = self.docs[self.starts[t] : self.stops[t]]
            p = np.minimum(np.searchsorted(inside, found), len(inside) - 1)
            overlap = overlap + (inside[p] == found)
            able = overlap + (len(long) - 1 - k) >= need
            if not able.all():
                found, overlap = found[able], overlap[able]
        union = self.sizes[found] + n - overlap
        return found[100 * overlap >= self.percent * union]

    def roots(self) -> np.ndarray:
        """The block's components, by the smallest index in each. Documents inside the largest
        one need no search of their own: its links outwards are found from the other side."""
        n = len(self.sizes)
        root = np.arange(n)
        asked = np.zeros(n, bool)
        while True:
            largest = np.bincount(root, minlength=n).argmax()
            open_ = np.flatnonzero(~asked & (root != largest))
            if not len(open_):
                return root
            asked[x := open_[0]] = True
            group = np.unique(root[np.append(self.linked(x), x)])
            root[np.isin(root, group)] = group[0]


PAIR = "a long, b long"
PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIR_SCHEMA)


def with_first(blocks: DataFrame, most: int) -> DataFrame:
    """(block, part, doc_id): blocks (block, doc_id) of more than ``most`` documents are dealt to
    parts, each of which also gets the block's first document."""
    sizes = blocks.groupBy("block").agg(F.count("*").alias("size"), F.min("doc_id").alias("rep")).where("size > 1")
    dealt = blocks.join(sizes, "block").withColumn("parts", F.ceil(F.col("size") / most).cast("int"))
    part = F.when(F.col("doc_id") == F.col("rep"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")))
    return dealt.select("block", F.explode(part).alias("part"), "doc_id")


def with_each_other(blocks: DataFrame, most: int) -> DataFrame:
    """(block, part, doc_id): blocks of more than ``most`` documents are dealt to parts such that
    each two documents meet in one of them."""
    sizes = blocks.groupBy("block").agg(F.count("*").alias("size")).where("size > 1")
    dealt = blocks.join(sizes, "block").withColumn("parts", F.ceil(2 * F.col("size") / most).cast("int"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != own)
    part = F.when(F.col("size") <= most, F.array(F.lit(0))).otherwise(F.transform(others, lambda p: (F.least(p, own) * F.col("parts") + F.greatest(p, own)).cast("int")))
    return dealt.select("block", F.explode(part).alias("part"), "doc_id")


def searched(parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside each (block, part), as edges to a component's first document."""
    rows = parts.join(sets.select("doc_id", "shingles"), "doc_id").select("block", "part", "doc_id", "shingles").repartition(shuffle_partitions(sets.sparkSession), "block", "part").sortWithinPartitions("block", "part", "doc_id")

    def search(ids, sets):
        if len(ids) > 1:
            root = Lists(sets, percent).roots()
            at = np.flatnonzero(root != np.arange(len(ids)))
            ids = np.array(ids, np.int64)
            yield pairs(ids[at], ids[root[at]])

    def task(batches):
        current, ids, sets = None, [], []
        for batch in batches:
            for block, number, doc, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, number) != current:
                    yield from search(ids, sets)
                    current, ids, sets = (block, number), [], []
                if not ids or ids[-1] != doc:
                    ids.append(doc)
                    sets.append(np.frombuffer(raw, "<u8"))
        yield from search(ids, sets)

    return rows.mapInArrow(task, PAIR)


def probed(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``candidates`` that link: b's set is probed by binary search for a's."""

    def task(batches):
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                overlap = int((y[at] == x).sum())
                if 100 * overlap >= percent * (len(x) + len(y) - overlap):
                    out[0].append(a)
                    out[1].append(b)
            yield pairs(*out)

    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return candidates.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(task, PAIR)


PARITIES = 512
WORDS = PARITIES // 64


def parities_of(sets: DataFrame) -> DataFrame:
    """doc_id and the set's parities as p0, p1, ... of 64 bits."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"p{i}", pa.int64()) for i in range(WORDS))])

    def task(batches):
        for batch in batches:
            odd = [np.packbits(np.bincount((np.frombuffer(raw, "<u8") % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1) for raw in batch.column(1).to_pylist()]
            words = np.array(odd, np.uint8).reshape(-1, PARITIES // 8).view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS))], schema=schema)

    return sets.select("doc_id", "shingles").mapInArrow(task, ", ".join(f"{f.name} long" for f in schema))


TOKENS = "doc_id long, n long, nq long, late_common long, late int, token long"


def tokens_of(sets: DataFrame, percent: int) -> DataFrame:
    """The shingles that order a document's prefix: those of the quarter first; all, if these
    are fewer than the prefix has."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("nq", pa.int64()), ("late_common", pa.int64()), ("late", pa.int32()), ("token", pa.int64())])

    def task(batches):
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in schema]
            for doc, n, common, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(raw, "<u8")
                q = int(np.searchsorted(h, QUARTER))
                own = h[:q] if q > n * (100 - percent) // 100 else h
                for p, v in zip(parts, (np.full(len(own), doc), np.full(len(own), n), np.full(len(own), q), np.full(len(own), common), (own >= QUARTER).astype(np.int32), own.view("<i8")), strict=True):
                    p.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), f.type) for p, f in zip(parts, schema, strict=True)], schema=schema)

    return sets.select("doc_id", "n", "late_common", "shingles").mapInArrow(task, TOKENS)


def components(docs: DataFrame, words: int = 5, percent: int = 80, most: int = 1500) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document with a doc_id."""
    spark = docs.sparkSession
    named = docs.select("doc_id", "text").where("doc_id is not null")
    missing = F.floor(F.col("n") * F.lit(100 - percent) / 100)
    able = (F.col("n") > 0) & (F.col("nq") - F.col("shared") <= missing)
    facts = written(listed(named, partial(map_lists, words), named.count()).select("doc_id", "n", "h1", "h2", able.alias("able")), "facts")
    classes = written(facts.where("able").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"))
    sets = written(sets_of(named.join(broadcast_if_small(reps, classes.count()), "doc_id", "left_semi"), words), "sets")
    release(spark)

    common = written(listed(sets.select("doc_id", "shingles"), map_whole_lists, sets.count()).select("doc_id", "shared", "late"), "common")
    release(spark)
    partner = written(sets.join(common, "doc_id").where(F.col("n") - F.col("shared") <= missing).drop("shared").withColumnRenamed("late", "late_common"), "partners")

    # Shingles that stand in one set only are the first of any prefix and lead nowhere.
    tokens = written(tokens_of(partner, percent), "tokens")
    lengths = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(lengths, "token")
    order = F.sort_array(F.collect_list(F.struct("late", "df", "token")))
    per_doc = shared.groupBy("doc_id", "n", "nq", "late_common").agg(order.alias("order"), F.sum("late").alias("late_shared"))
    # A late shingle of df 1 may stand in a document that emitted its quarter only: it isn't lonely.
    early = F.size("order") - F.col("late_shared")
    lonely = F.col("nq") - early + F.col("n") - F.col("nq") - F.col("late_common")
    token = F.transform("order", lambda t: t["token"])
    prefixes = written(
        per_doc.withColumn("lonely", lonely).withColumn("all", token).withColumn("prefix", F.slice("all", F.lit(1), F.greatest(missing + 1 - F.col("lonely"), F.lit(0)).cast("int")))
        .where(F.size("prefix") > 0).select("doc_id", "n", "lonely", "prefix", F.array_min("all").alias("low"), F.array_max("all").alias("high")), "prefixes",
    )

    links = None
    for block in ("low", "high"):
        found = searched(with_first(prefixes.select(F.col(block).alias("block"), "doc_id"), most), partner, percent)
        links = found if links is None else links.unionByName(found)
    links = written(links, "links")
    label = written(stars(links), "labels")

    # Where a pair's first common shingle stands, all before it is missing from the other set.
    rows = prefixes.select("doc_id", "n", "lonely", F.posexplode("prefix").alias("at", "token")).withColumn("left", F.col("n") - F.col("lonely") - F.col("at")).drop("lonely", "at").join(label, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    mixed = rows.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("token")
    open_ = written(rows.join(mixed, "token"), "open")
    crowded = open_.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > FEW).select("token")
    met = searched(with_each_other(open_.join(crowded, "token").select(F.col("token").alias("block"), "doc_id"), most), partner, percent)
    open_ = open_.join(crowded, "token", "left_anti")
    odd = parities_of(partner.join(open_.select("doc_id").distinct(), "doc_id", "left_semi"))
    open_ = written(open_.join(odd, "doc_id"), "open-parities")
    words_ = [f"p{i}" for i in range(WORDS)]
    a, b = (open_.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "left", "label", *words_)]) for s in "ab")
    most_shared = F.least("left_a", "left_b")
    differing = sum(F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in words_)
    enough = lambda shared: shared * 100 >= (F.col("n_a") + F.col("n_b") - shared) * percent
    near = (F.col("label_a") < F.col("label_b")) & enough(most_shared) & enough(F.floor((F.col("n_a") + F.col("n_b") - differing) / 2))
    candidates = written(a.join(b, "token").where(near).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct(), "candidates")
    across = written(probed(candidates, partner, percent).unionByName(met), "across")
    if not across.isEmpty():
        label = written(stars(links.unionByName(across)), "labels")

    final = classes.join(label.withColumnRenamed("doc_id", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("class"))
    return (
        facts.withColumn("h1", F.when(F.col("able"), F.col("h1"))).join(final, ["h1", "h2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("component_id"))
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are linked, directly or not, with one of smaller doc_id."""
    found = components(docs, words, percent).where("doc_id <> component_id").select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{n}`") for n in docs.columns])
