"""Removal of repeated byte strings by refining q-gram buckets.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document of
smaller doc_id. As only equality of the first ``length`` bytes of suffixes matters, the
refinement of suffix buckets stops there:

1. Every suffix begins in the bucket of its first 8 bytes, which are its identifier. Buckets are
   refined by the identifiers at a later offset, and each refinement uses those of the one
   before: 8 bytes, 16, then q, half the length.
2. Of the q-gram buckets met by a string of ``length`` bytes, the smallest is its anchor;
   neighbouring suffixes with one anchor form a run. Runs are sorted by (anchor, digest of all
   bucket identifiers at the run's later offsets): equal pairs are equal strings, settled at
   once for the whole run.
3. Runs whose anchor bucket still holds different strings are refined once more, suffix by
   suffix, by the pair of bucket identifiers at the offsets 0 and q, through the same exchange.

Entries that a map task can settle among its own rows never leave it, and of each bucket it
sends the smallest document only. Of an anchor with different strings in a task's documents it
sends a mark, and its runs to step 3. So a task sends at most one row for a hot passage or anchor
each time it sends, and neither gathers in one task. Refined identifiers are 64-bit digests and a
pair has 96 bits or more.

Defined results: a null text counts as empty, and a text shorter than ``length`` is kept; rows
without a doc_id are kept whole and remove nothing; rows of one doc_id, copies or with texts of
their own, are one document, whose rows don't remove one another's bytes; their different texts
may hold 2 GiB together. An empty table gives an empty one. Further columns stay as they are,
whatever their names.
"""

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkact.llm.common import mix64, release, written
from sparkact.llm.exchange import all_of, exchanged, first_of_runs, rows_of

LENGTH = 50
FLUSH = 1_000_000  # entries that a map task holds before it settles and sends them
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
MASK = (1 << 64) - 1
ENTRY = ["<u8", "<u4", "<i8", "<u4", "<u4"]  # key, second key, document, position, bytes
SPAN = ["<i8", "<u4", "<u4"]
SPANS = "doc_id long, pos long, n long, code int"
SPANS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("code", pa.int32())])
COVERED, REFINE = 1, 2


def grams(b: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifiers of all q-grams of ``b`` (uint8)."""
    first = 1 << min(q, 8).bit_length() - 1
    ids, width = b.astype(np.uint64), 1
    while width < first:  # the bytes themselves
        ids = (ids[: len(ids) - width] << np.uint64(8 * width)) | ids[width:]
        width *= 2
    return refined(ids, width, q)


def refined(ids: np.ndarray, width: int, q: int) -> np.ndarray:
    """Identifiers of q-grams from those of ``width`` bytes: buckets are refined by the identifiers
    at the offset of their width (or less, for the last bytes), and these again."""
    if width == q:
        return mix64(ids * np.uint64(BASE2))
    later = min(width, q - width)
    return refined(mix64(ids[: len(ids) - later] * np.uint64(BASE)) + ids[later:] * np.uint64(BASE2), width + later, q)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if width < w else x


class Powers:
    """Powers of BASE2 and of its inverse modulo 2**64, as many as asked for."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            inverse = pow(BASE2, -1, 1 << 64)
            self.up, self.down = ones(BASE2, size), ones(inverse, size)
        return self.up[:n], self.down[:n]


def ones(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out)


def runs(texts: list[bytes], powers: Powers, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor, digest, text's index, position, bytes) of the runs of all texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.uint64)
    if len(b) < length:
        return none, none, none.astype(np.int64), none.astype(np.int64), none.astype(np.int64)
    q = length // 2
    ids = grams(b, q)
    anchor = sliding_min(ids, length - q + 1)  # one for each string of ``length`` bytes
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= ends[owner]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    change[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(anchor)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    up, down = powers.of(len(b) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids * up[: len(ids)], out=sums[1:])
    stop = last + length - q + 1  # behind the bucket identifiers that the run's strings hold
    digest = mix64((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64))
    who = owner[first]
    return anchor[first], digest, who, first - (ends - sizes)[who], last - first + length


def settled(key, second, doc, pos, n) -> tuple[np.ndarray, np.ndarray]:
    """(order, covered): a sorting of the entries, and which of them, so sorted, equal an entry
    of a smaller document."""
    order = np.lexsort((doc, second, key))
    k, s, d = key[order], second[order], doc[order]
    head = np.flatnonzero(first_of_runs(k, s))
    smallest = np.repeat(d[head], np.diff(np.append(head, len(d))))
    return order, d > smallest


def opened(key, second, doc) -> np.ndarray:
    """Of sorted entries: whether their key has different strings and stands in several documents."""
    head = first_of_runs(key)
    starts = np.flatnonzero(head)
    kinds = np.add.reduceat(first_of_runs(key, second).astype(np.int64), starts)
    return ((kinds > 1) & (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)))[np.cumsum(head) - 1]


def sent(parts: list[tuple[np.ndarray, ...]], buckets: int, refine: bool) -> Iterator[tuple[int, int, bytes]]:
    """Packed rows: kind 0 entries for the reduce tasks, kind 1 spans that are settled already, and
    if asked for kind 2 spans to REFINE and kind 3 their keys."""
    entry = [np.concatenate(c).astype(k) for c, k in zip(zip(*parts, strict=True), ENTRY, strict=True)]
    parts.clear()
    if not len(entry[0]):
        return
    order, covered = settled(*entry)
    entry = [a[order] for a in entry]
    own = ~covered
    if refine:
        todo = opened(*entry[:3]) & own
        yield from rows_of(2, mix64(entry[2][todo].astype(np.uint64)), [a[todo] for a in entry[2:]], buckets)
        marks = np.unique(entry[0][todo])
        yield from rows_of(3, marks, [marks], buckets)
        own &= ~todo
    yield from rows_of(0, entry[0][own], [a[own] for a in entry], buckets)
    yield from rows_of(1, mix64(entry[2][covered].astype(np.uint64)), [a[covered] for a in entry[2:]], buckets)


def spans(doc, pos, n, code: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(pos.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.full(len(doc), code, np.int32))], schema=SPANS_SCHEMA)


def resolved(refine: bool):
    """The reduce side: COVERED spans, and if asked for those to REFINE."""

    def reduce_bucket(held):
        for kind, code in ((1, COVERED), (2, REFINE)):
            if kind in held:
                yield spans(*all_of(held[kind], SPAN), code)
        if 0 not in held:
            return
        entry = all_of(held[0], ENTRY)
        order, covered = settled(*entry)
        key, second, doc, pos, n = (a[order] for a in entry)
        yield spans(doc[covered], pos[covered], n[covered], COVERED)
        if refine:
            marks = np.unique(np.concatenate(all_of(held[3], ["<u8"]))) if 3 in held else key[:0]
            open_ = ~covered & (opened(key, second, doc) | np.isin(key, marks))
            yield spans(doc[open_], pos[open_], n[open_], REFINE)

    return reduce_bucket


def chunks(batches, columns: int, most: int = 1 << 20):
    """Lists of rows with about ``most`` bytes of text (the last column)."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                text = (row[columns - 1] or "").encode("utf-8", "surrogatepass")
                held.append((*row[: columns - 1], text))
                size += len(text)
                if size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def map_runs(length: int):
    def task(batches, buckets):
        powers, parts, n = Powers(), [], 0
        for rows in chunks(batches, 3):
            docs, base = (np.array([r[i] for r in rows], np.int64) for i in range(2))
            anchor, digest, who, pos, size = runs([r[2] for r in rows], powers, length)
            parts.append((anchor, digest >> np.uint64(32), docs[who], base[who] + pos, size))
            n += len(anchor)
            if n >= FLUSH:
                yield from sent(parts, buckets, True)
                parts, n = [], 0
        if parts:
            yield from sent(parts, buckets, True)

    return task


PLACE = "shiftleft(pos, 32) | n"  # a span in one long


def within(spans_: np.ndarray, base: int, size: int) -> np.ndarray:
    """The spans of a document's texts that lie in the one of ``size`` bytes from ``base`` on, as places in it."""
    pos = spans_ >> 32
    return spans_[(pos >= base) & (pos < base + size)] - (base << 32)


def map_suffixes(length: int):
    """Entries for every suffix of the runs that are to be refined, of rows (doc_id, base, spans, text)."""
    q = length // 2

    def task(batches, buckets):
        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(3).to_pylist()]
                begin = part.column(1).to_numpy(zero_copy_only=False)
                own_spans = [within(w.values.to_numpy(zero_copy_only=False), int(b), len(t)) for w, b, t in zip(part.column(2), begin, raw, strict=True)]
                base = np.cumsum([0, *map(len, raw)])
                span = np.concatenate(own_spans)
                if not len(span):
                    continue
                ids = grams(np.frombuffer(b"".join(raw), np.uint8), q)
                own = np.repeat(np.arange(len(raw)), [len(w) for w in own_spans])
                count = (span & 0xFFFFFFFF) - length + 1
                ends = np.cumsum(count)
                where = np.repeat(base[own] + (span >> 32) - (ends - count), count) + np.arange(ends[-1])
                here, who = ids[where], np.repeat(own, count)
                doc = part.column(0).to_numpy(zero_copy_only=False)
                parts.append((mix64(here + ids[where + q] * np.uint64(BASE2)), here >> np.uint64(32), doc[who], where - base[who] + begin[who], np.full(len(where), length)))
                held += len(where)
                if held >= FLUSH:
                    yield from sent(parts, buckets, False)
                    parts, held = [], 0
        if parts:
            yield from sent(parts, buckets, False)

    return task


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, base, row: all columns) of the rows with a doc_id: the texts of one doc_id that differ lie one
    behind the other in one numbering of bytes, each from its ``base`` on; equal ones lie in one place."""
    digest = F.coalesce(F.xxhash64("row.text"), F.lit(0))
    held = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row"))
    sizes = held.select("doc_id", digest.alias("h"), F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n"))
    several = sizes.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("doc_id")
    texts = written(sizes.join(several, "doc_id").groupBy("doc_id", "h").agg(F.max("n").alias("n")), "texts-of-one-id")
    if texts.isEmpty():
        return held.select("doc_id", F.lit(0).cast("long").alias("base"), "row")
    before = F.sum("n").over(W.partitionBy("doc_id").orderBy("h").rowsBetween(W.unboundedPreceding, -1))
    bases = texts.select("doc_id", "h", F.coalesce(before, F.lit(0)).alias("start"), "n")
    base = F.when(F.col("start") + F.col("n") >= 1 << 31, F.raise_error(F.lit("the different texts of one doc_id hold more than 2 GiB")).cast("long")).otherwise(F.col("start"))
    bases = bases.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), base.alias("start"))
    joined = held.join(bases, (F.col("doc_id") == F.col("_d")) & (digest == F.col("_h")), "left")
    return joined.select("doc_id", F.coalesce("start", F.lit(0)).cast("long").alias("base"), "row")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans array<long>) of the documents, as :func:`placed`, that have bytes to remove; see PLACE."""
    spark = docs.sparkSession
    named = docs.select("doc_id", "base", F.col("row.text").alias("text"))
    first = written(exchanged(named, map_runs(length), resolved(True), SPANS), "runs")
    release(spark)
    todo = first.where(F.col("code") == REFINE).groupBy("doc_id").agg(F.collect_set(F.expr(PLACE)).alias("spans"))
    late = written(exchanged(named.join(todo, "doc_id").select("doc_id", "base", "spans", "text"), map_suffixes(length), resolved(False), SPANS), "suffixes")
    release(spark)
    return first.where(F.col("code") == COVERED).unionByName(late).groupBy("doc_id").agg(F.collect_list(F.expr(PLACE)).alias("spans"))


def kept(text: str | None, where: np.ndarray | None, base: int) -> tuple[bytes, int, int, int]:
    """(remaining bytes, bytes, removed bytes, removed runs) of a text from ``base`` on in its document."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    where = None if where is None else within(where, base, len(raw))
    if where is None or not len(where):
        return raw, len(raw), 0, 0
    pos, n = where >> 32, where & 0xFFFFFFFF
    steps = np.bincount(pos, minlength=len(raw) + 1) - np.bincount(pos + n, minlength=len(raw) + 1)
    gone = np.cumsum(steps[:-1]) > 0
    runs_ = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), runs_


def without_id(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("array<long>").alias("spans"), F.lit(0).cast("long").alias("base"))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What is removed of every document; see REPORT."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in REPORT.split(", "))])

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text, where, base in zip(part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), strict=True):
                    rest, n, removed, count = kept(text, where.values.to_numpy(zero_copy_only=False) if where.is_valid else None, base)
                    rows.append((n, removed, count, sha256(rest).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    docs = docs.select("doc_id", "text")
    held = placed(docs)
    joined = held.join(repeated(held, length), "doc_id", "left").select("doc_id", "row.text", "spans", "base")
    return joined.unionByName(without_id(docs)).mapInArrow(task, REPORT)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of their texts (and what is then left of a
    character that was cut); all other columns as they are."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else kept(t, s, b)[0].decode("utf-8", "ignore") for t, s, b in zip(texts, spans, bases, strict=True)], dtype=object)

    held = placed(docs)
    joined = held.join(repeated(held, length), "doc_id", "left").select("row", "spans", "base")
    alone = docs.where("doc_id is null").select(F.struct("*").alias("row"), F.lit(None).cast("array<long>").alias("spans"), F.lit(0).cast("long").alias("base"))
    text = cut("row.text", "spans", "base")
    return joined.unionByName(alone).select(*[text.alias(n) if n == "text" else F.col("row").getField(n).alias(n) for n in docs.columns])
