"""A full-text index: posting lists in blocks, in folders by term, for searches that read only
their terms.

Terms are runs of ASCII letters and digits in lower case and, of runs of Chinese characters, all
pairs and triples. A posting is a document's key, how often it has the term and how many terms it
has in all. Postings are packed into blocks of one term and at most BLOCK postings: keys as
differences, all three as bytes of seven bits. Tasks pack what they read before the only shuffle, which deals blocks
by ranges of (bucket of the term, term, first key), so that the list of a very frequent term lies in many
partitions; there small blocks of a term are merged. A block is a row of a Parquet table that is
partitioned by bucket, so a search opens the folders of its terms' buckets and, by the file's
statistics on the sorted terms, few row groups of them.

Defined results: ``key`` is a unique long (rows that repeat one are documents of their own, whose scores add
up); rows without one are not indexed; a null text has no term but counts as a document of length 0. An
empty table makes an empty index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkact.sources.shared import new_path, written

BLOCK = 1024
WORD = "[A-Za-z0-9]+"
CJK = "[㐀-䶿一-鿿豈-﫿]+"
WIDTHS = (2, 3)
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6  # of a term that more than half of all documents have

BLOCKS = "bucket int, term string, n int, occurrences long, first_key long, keys binary, counts binary, lengths binary"
MADE = "term string, n int, occurrences long, first_key long, keys binary, counts binary, lengths binary"
POSTINGS = "term string, key long, tf long, dl long"
OPENED = ("term", "n", "first_key", "keys", "counts", "lengths")
DEALT = "shard int, terms array<string>, idfs array<double>, sizes array<int>, firsts array<long>, keys binary, counts binary, lengths binary"
BEST = "words string, key long, score double, hits long"
BLOCK_SCHEMA = pa.schema([("term", pa.string()), ("n", pa.int32()), ("occurrences", pa.int64()), ("first_key", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("lengths", pa.binary())])
BUCKETED = pa.schema([("bucket", pa.int32()), *BLOCK_SCHEMA])
BEST_SCHEMA = pa.schema([("words", pa.string()), ("key", pa.int64()), ("score", pa.float64()), ("hits", pa.int64())])
FLUSH, SLICE = 1_000_000, 64  # terms that a task packs at a time, rows that it takes at a time
READ, OPEN, MERGE = 4_000_000, 200_000, 400_000  # bytes of text cut into terms, postings opened and merged at a time
SHARD_TERMS, SHARD_DOCS, SHARD_LISTS = 8_000_000, 16_384, 4096  # terms and documents of a shard on average, lists of terms that meet it in a task
SENT = 100_000  # terms that are broadcast; more of them meet the blocks by a shuffle
LOWER = np.array([c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 else 0 for c in range(256)], np.uint8)


def terms(text: Column) -> Column:
    """All terms of a text, with repetitions; no order is meant."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(text, F.lit(CJK), F.lit(0))
    none = F.array().cast("array<string>")

    def windows(width: int) -> Column:
        cut = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - width + 1), lambda i: F.substring(r, i, F.lit(width)))
        return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= width, cut(r)).otherwise(none)))

    return F.coalesce(F.concat(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), *map(windows, WIDTHS)), none)

def terms_of(text: str) -> list[str]:
    """The distinct terms of a query, as :func:`terms` makes them."""
    out = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(WORD, text)]
    for run in re.findall(CJK, text):
        out += [run[i : i + w] for w in WIDTHS for i in range(len(run) - w + 1)]
    return list(dict.fromkeys(out))


def tokenised(batches) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) become rows (key, terms) with the terms of :func:`terms`."""
    for batch in batches:
        texts = batch.column(1).cast(pa.string()).fill_null("")
        size = np.asarray(pc.binary_length(texts)).astype(np.int64)
        edges = edges_of(size, READ)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists_of(texts.slice(a, b - a))], names=["key", "terms"])


def edges_of(size: np.ndarray, most: int) -> list[int]:
    """Where to cut rows of these sizes, so that a piece has about ``most`` in all or one row."""
    part = (np.cumsum(size) - size) // most
    return [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(size)]


def lists_of(texts: pa.Array) -> pa.ListArray:
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    low = LOWER[raw]
    inside = np.concatenate(([False], low > 0, [False]))
    opens = np.zeros(len(raw) + 1, bool)  # where a text begins
    opens[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | opens))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | opens))
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[low > 0]))
    counts = np.diff(np.searchsorted(starts, at))
    wide = np.concatenate(([0], np.cumsum(((raw >= 0xE3) & (raw <= 0xE9)) | (raw == 0xEF))))  # bytes that Chinese characters begin with
    more, owner = [], []
    for i in np.flatnonzero(np.diff(wide[at])).tolist():
        found = [run[j : j + w] for run in re.findall(CJK, raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")) for w in WIDTHS for j in range(len(run) - w + 1)]
        more += found
        owner += [i] * len(found)
    if more:
        rows = np.concatenate((np.repeat(np.arange(len(counts)), counts), owner))
        flat = pa.concat_arrays([flat, pa.array(more, pa.string())]).take(pa.array(np.argsort(rows, kind="stable")))
        counts = counts + np.bincount(owner, minlength=len(counts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), flat)


def sizes_of(v: np.ndarray) -> np.ndarray:
    """How many bytes of seven bits each value (not negative) takes."""
    size = np.ones(len(v), np.int64)
    rest = v >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest = rest >> np.uint64(7)
    return size


def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The values from each edge to the next as one binary: each value lowest bits first, with bit 7 set in all its bytes
    but the last."""
    v = values.astype(np.uint64)
    size = sizes_of(v)
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(ends[-1]), np.uint8)
    for j in range(int(size.max(initial=0))):
        has = size > j
        low = (v[has] >> np.uint64(7 * j)) & np.uint64(127)
        out[ends[:-1][has] + j] = low.astype(np.uint8) | ((size[has] - 1 > j).astype(np.uint8) << 7)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(ends[edges].astype(np.int32)), pa.py_buffer(out)])


def unpacked(column: pa.Array) -> np.ndarray:
    """All values of all binaries, one after the other."""
    if not len(column):
        return np.zeros(0, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts).view(np.int64)


def cut(names: pa.Array, run: np.ndarray, keys: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of postings that are sorted by (run, key); ``names`` has each run's term."""
    if not len(run):
        return
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    place = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
    starts = np.flatnonzero(place % BLOCK == 0)
    edges = np.append(starts, len(run))
    steps = np.concatenate(([0], np.diff(keys)))
    steps[starts] = 0
    columns = [names.take(pa.array(run[starts])), pa.array(np.diff(edges).astype(np.int32)), pa.array(np.add.reduceat(tf, starts)), pa.array(keys[starts]), packed(steps, edges), packed(tf, edges), packed(dl, edges)]
    yield pa.RecordBatch.from_arrays(columns, schema=BLOCK_SCHEMA)


def blocks(batches) -> Iterator[pa.RecordBatch]:
    """Rows (key, terms) become blocks of the postings of about FLUSH terms at a time."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            held.append(batch.slice(at, SLICE))
            size += len(held[-1].column(1).flatten())
            if size >= FLUSH:
                yield from blocks_of(held)
                held, size = [], 0
    if held:
        yield from blocks_of(held)


def blocks_of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(parts).combine_chunks()
    keys = np.asarray(table["key"]).astype(np.int64)
    lists = table["terms"].combine_chunks()
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    pair, tf = np.unique(np.asarray(coded.indices).astype(np.int64) * len(keys) + np.repeat(place, lengths), return_counts=True)
    row = order[pair % len(keys)]
    yield from cut(coded.dictionary, pair // len(keys), keys[row], tf.astype(np.int64), lengths[row])


def postings_of(columns: list[pa.Array]) -> tuple[np.ndarray, ...]:
    """(block's number, key, tf, dl) of all postings of blocks (n, first_key, keys, counts, lengths)."""
    n, first = (np.asarray(c).astype(np.int64) for c in columns[:2])
    owner = np.repeat(np.arange(len(n)), n)
    steps, tf, dl = map(unpacked, columns[2:])
    sums = np.cumsum(steps)
    starts = np.cumsum(n) - n
    return owner, sums - np.repeat(sums[starts], n) + np.repeat(first, n) if len(n) else sums, tf, dl


def pieces(batches, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Blocks, of which ``column`` has the sizes, in pieces of about ``most`` postings, whatever the batches hold."""
    for batch in batches:
        edges = edges_of(np.asarray(batch.column(column)).astype(np.int64), most)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def merged(batches) -> Iterator[pa.RecordBatch]:
    """Blocks (bucket, term, n, first_key, keys, counts, lengths), sorted by term, as fewer and fuller ones of the same postings."""
    for batch in pieces(batches, 2, MERGE):
        term = batch.column(1).dictionary_encode()
        code = np.asarray(term.indices).astype(np.int64)
        owner, keys, tf, dl = postings_of(batch.columns[2:])
        order = np.lexsort((keys, code[owner]))
        bucket = np.zeros(len(term.dictionary), np.int32)
        bucket[code] = np.asarray(batch.column(0))
        for out in cut(term.dictionary, code[owner][order], keys[order], tf[order], dl[order]):
            own = bucket[np.asarray(pc.index_in(out.column(0), term.dictionary))]
            yield pa.RecordBatch.from_arrays([pa.array(own), *out.columns], schema=BUCKETED)


def opened(batches) -> Iterator[pa.RecordBatch]:
    """The postings of blocks (term, n, first_key, keys, counts, lengths), with what else a block's row has."""
    for batch in pieces(batches, 1, OPEN):
        owner, keys, tf, dl = postings_of(batch.columns[1:6])
        own = [c.take(pa.array(owner)) for c in (batch.column(0), *batch.columns[6:])]
        yield pa.RecordBatch.from_arrays([own[0], pa.array(keys), pa.array(tf), pa.array(dl), *own[1:]], names=["term", "key", "tf", "dl", *batch.schema.names[6:]])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    x = keys.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def dealt(batches, shards: int) -> Iterator[pa.RecordBatch]:
    """Blocks (term, n, first_key, keys, counts, lengths, idf) dealt to shards by their keys: a row for each shard of a
    piece, with its postings term by term, packed as in a block."""
    for batch in pieces(batches, 1, OPEN):
        term = batch.column(0).dictionary_encode()
        code = np.asarray(term.indices).astype(np.int64)
        idf = np.zeros(len(term.dictionary))
        idf[code] = np.asarray(batch.column(6))
        owner, keys, tf, dl = postings_of(batch.columns[1:6])
        run = shard_of(keys, shards) * len(idf) + code[owner]
        order = np.lexsort((keys, run))
        run, keys, tf, dl = run[order], keys[order], tf[order], dl[order]
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        shard, own = np.divmod(run[starts], len(idf))
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))  # each row's first run
        offsets = pa.array(np.append(first, len(starts)).astype(np.int32))
        edges = np.append(starts[first], len(run))
        steps = np.concatenate(([0], np.diff(keys)))
        steps[starts] = 0
        runs = [term.dictionary.take(pa.array(own)), pa.array(idf[own]), pa.array(np.diff(starts, append=len(run)).astype(np.int32)), pa.array(keys[starts])]
        columns = [pa.array(shard[first].astype(np.int32)), *[pa.ListArray.from_arrays(offsets, x) for x in runs], packed(steps, edges), packed(tf, edges), packed(dl, edges)]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "terms", "idfs", "sizes", "firsts", "keys", "counts", "lengths"])


def best_of_shard(rows: pa.Table, asked: pa.Table, mean: float, k: int, digits: int) -> pa.Table:
    """The best ``k`` documents of a shard, whose postings :func:`dealt` made, for each list of terms ``asked`` (words,
    joined by spaces). Weights are summed in the order of the words, so that equal texts have equal scores."""
    rows = rows.combine_chunks()
    coded = rows["terms"].combine_chunks().flatten().dictionary_encode()
    codes, parts, done = np.asarray(coded.indices), [], 0
    edges = edges_of(np.asarray(pc.binary_length(rows["counts"])).astype(np.int64), OPEN)  # bytes, at least one a posting
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        idf, n, first = (rows[c].slice(a, b - a).combine_chunks().flatten() for c in ("idfs", "sizes", "firsts"))
        owner, keys, tf, dl = postings_of([n, first, *(rows[c].slice(a, b - a).combine_chunks() for c in ("keys", "counts", "lengths"))])
        parts.append((codes[done : done + len(n)][owner], keys, np.asarray(idf)[owner] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / mean))))
        done += len(n)
    found = []
    if parts:
        code, keys, part = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(code, kind="stable")
        ids, doc = np.unique(keys, return_inverse=True)
        doc, part = doc[order], part[order]
        ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary))).tolist()
        place = {t: slice(a, b) for t, a, b in zip(coded.dictionary.to_pylist(), [0, *ends[:-1]], ends, strict=True)}
        for i, words in enumerate(asked["words"].to_pylist()):
            at = [place[t] for t in words.split(" ") if t in place]
            if not at:
                continue
            hit = np.concatenate([doc[x] for x in at])
            hits = np.bincount(hit, minlength=len(ids))
            score = np.floor(np.bincount(hit, np.concatenate([part[x] for x in at]), len(ids)) * 10.0**digits + 0.5) / 10.0**digits
            some = np.flatnonzero(hits)
            if len(some) > k:
                some = some[score[some] >= np.partition(score[some], -k)[-k]]
            some = some[np.lexsort((ids[some], -score[some]))[:k]]
            found.append((np.full(len(some), i), ids[some], score[some], hits[some]))
    own, *columns = map(np.concatenate, zip(*found, strict=True)) if found else ([], [], [], [])
    return pa.Table.from_arrays([asked["words"].take(pa.array(own, pa.int64())), *[pa.array(c, f.type) for c, f in zip(columns, list(BEST_SCHEMA)[1:], strict=True)]], schema=BEST_SCHEMA)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """Postings and the two totals of a table, as :func:`build` left them in a folder."""

    spark: SparkSession
    path: str
    buckets: int

    def blocks(self, names: list[str]) -> DataFrame:
        """The blocks of these terms: filters on the folder and on the file's sorted terms."""
        where = [bucket_of(F.lit(n), self.buckets) for n in names]  # constants by the time that folders are chosen
        table = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/postings")
        return table.where(F.col("bucket").isin(where) & F.col("term").isin(names)) if names else table.limit(0)

    def postings(self, names: list[str]) -> DataFrame:
        return self.blocks(names).select(*OPENED).mapInArrow(opened, POSTINGS)

    def totals(self) -> tuple[int, int]:
        """(documents, terms of all documents)."""
        row = self.spark.read.parquet(f"{self.path}/totals").agg(F.sum("documents"), F.sum("terms")).first()
        return row[0] or 0, row[1] or 0

    def any_of(self, query: str) -> DataFrame:
        """(key) of the documents with a term of the query."""
        return self.postings(terms_of(query)).select("key").distinct()

    def all_of(self, query: str) -> DataFrame:
        """(key) of the documents with all terms of the query; a query without terms finds none."""
        names = terms_of(query)
        return self.postings(names).groupBy("key").agg(F.count_distinct("term").alias("c")).where(F.col("c") == len(names)).select("key")

    def scored(self, query: str, every: bool = False) -> DataFrame:
        """(key, score) by BM25 of the documents with any (or ``every``) term of the query."""
        names = terms_of(query)
        asked = self.spark.createDataFrame([(0, n) for n in names], "query_id long, term string")
        out = self.weighed(self.postings(names), asked, self.frequencies(names), F.broadcast)  # a row for each term of one query
        return (out.where(F.col("hits") == len(names)) if every else out).select("key", "score")

    def frequencies(self, names: list[str]) -> DataFrame:
        """(term, df), from the blocks' sizes alone."""
        return self.blocks(names).groupBy("term").agg(F.sum("n").cast("long").alias("df"))

    def weighed(self, postings: DataFrame, asked: DataFrame, frequencies: DataFrame, sent=lambda df: df) -> DataFrame:
        """(query_id, key, score, hits) of the postings of ``asked`` (query_id, term)."""
        idf, part = self.formulas()
        weights = asked.join(frequencies, "term").select("query_id", "term", idf.alias("idf"))
        return postings.join(sent(weights), "term").groupBy("query_id", "key").agg(F.sum(part).alias("score"), F.count("*").alias("hits"))

    def formulas(self) -> tuple[Column, Column]:
        """(idf of ``df``, what a posting with that ``idf`` adds to a score)."""
        n, total = self.totals()
        raw = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        mean = total / n if n else 1.0
        part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))
        return F.when(raw > 0, raw).otherwise(LEAST_IDF), part

    def weighted(self, names: DataFrame, sent=lambda df: df) -> DataFrame:
        """The blocks of the terms ``names`` (term, unique) with ``idf``. Terms meet blocks, not postings, so that a
        frequent term is no row of one task."""
        idf, _ = self.formulas()
        wanted = names.select("term", bucket_of(F.col("term"), self.buckets).alias("bucket"))
        table = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/postings")
        frequencies = table.join(sent(wanted), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("n").alias("df")).select("bucket", "term", idf.alias("idf"))
        return table.join(sent(frequencies), ["bucket", "term"]).select(*OPENED, "idf")

    def parts(self, names: DataFrame) -> DataFrame:
        """(term, key, part): what each posting of the terms ``names`` (term, unique) adds to a score."""
        _, part = self.formulas()
        return self.weighted(names).mapInArrow(opened, POSTINGS + ", idf double").select("term", "key", part.alias("part"))

    def scored_each(self, queries: DataFrame, text: str = "text", query_key: str = "query_id") -> DataFrame:
        """(query_id, key, score, hits) for a table of queries of any size. Their distinct terms meet the blocks by
        (bucket, term), so that a block is opened once, whatever the number of queries. A row is made for each query
        and each document with one of its terms: :meth:`best_each` is for the best of them."""
        asked = asked_terms(queries, text, query_key)
        wanted = asked.select("term", bucket_of(F.col("term"), self.buckets).alias("bucket")).distinct()
        found = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/postings").join(wanted, ["bucket", "term"], "left_semi")
        frequencies = found.groupBy("term").agg(F.sum("n").cast("long").alias("df"))
        return self.weighed(found.select(*OPENED).mapInArrow(opened, POSTINGS), asked, frequencies)

    def best_each(self, queries: DataFrame, k: int, text: str = "text", query_key: str = "query_id", digits: int = 9) -> DataFrame:
        """(query_id, key, score, hits, rank from 1): the ``k`` documents of greatest score for each of a table of queries
        of any size; scores are rounded to ``digits``, equal ones ordered by key.

        Documents are dealt to shards by their keys. The postings of a shard, packed, meet the lists of terms in one task,
        which keeps ``k`` documents of each; so no row is made for a query and a document that has one of its terms, nor
        for a posting. Queries of the same terms are answered once. No limit drops a document that would be among the best."""
        n, total = self.totals()
        mean = total / n if n else 1.0
        shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_DOCS), -(-total // SHARD_TERMS))
        words = F.array_join(F.array_sort(F.collect_list("term")), " ")
        asked = written(asked_terms(queries, text, query_key).groupBy("query_id").agg(words.alias("words")), "asked")
        lists = asked.select("words").distinct()
        wanted = lists.select(F.explode(F.split("words", " ")).alias("term")).distinct()
        strips = max(1, -(-lists.count() // SHARD_LISTS))
        every = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
        found = self.weighted(wanted, F.broadcast if wanted.count() <= SENT else lambda df: df)
        left = found.mapInArrow(lambda batches: dealt(batches, shards), DEALT).withColumn("strip", every(strips))
        right = lists.select("words", F.pmod(F.xxhash64("words"), F.lit(strips)).cast("int").alias("strip"), every(shards).alias("shard"))
        task = lambda x, y: best_of_shard(x, y, mean or 1.0, k, digits)
        partial = left.groupBy("shard", "strip").cogroup(right.groupBy("shard", "strip")).applyInArrow(task, BEST)
        best = F.row_number().over(W.partitionBy("words").orderBy(F.desc("score"), "key"))  # k rows of each shard at most
        return asked.join(partial.withColumn("rank", best).where(F.col("rank") <= k), "words").select("query_id", "key", "score", "hits", "rank")


def asked_terms(queries: DataFrame, text: str, query_key: str) -> DataFrame:
    """(query_id, term), each once, also where rows share their ``query_key``."""
    return queries.select(F.col(f"`{query_key}`").alias("query_id"), F.explode(terms(F.col(f"`{text}`"))).alias("term")).distinct()


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, buckets: int = 64) -> Index:
    """Index ``docs`` in a folder (a new one in the shared folder by default)."""
    spark = docs.sparkSession
    path = path or new_path(spark, "index")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = docs.where(F.col(f"`{key}`").isNotNull())
    rows = named.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    made = rows.mapInArrow(lambda batches: blocks(tokenised(batches)), MADE).withColumn("bucket", bucket_of(F.col("term"), buckets))
    made = written(made, "blocks")  # ranges are sampled: without this all texts would be read and packed twice
    ranged = made.repartitionByRange(n, "bucket", "term", "first_key").sortWithinPartitions("bucket", "term", "first_key")
    ranged.select("bucket", *OPENED).mapInArrow(merged, BLOCKS).write.option("compression", "zstd").option("maxRecordsPerFile", 1_000_000).partitionBy("bucket").parquet(f"{path}/postings")
    occurrences = spark.read.schema(BLOCKS).parquet(f"{path}/postings").agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("terms"))
    documents = named.agg(F.count("*").alias("documents"))
    documents.crossJoin(F.broadcast(occurrences)).write.parquet(f"{path}/totals")  # a row and a row
    return Index(spark, path, buckets)
