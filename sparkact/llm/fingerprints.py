"""Canonical exact fingerprints.

A text is normalised (NFKC), case-folded, normalised again, and its runs of white space become
one space. Its fingerprint is the 128-bit xxhash of the result. Texts of equal hash are then
compared byte for byte: each bucket's smallest doc_id is the representative, and a text that
differs from it (a collision) gets a fingerprint of its own, by as many rounds as there are
different texts in a bucket. Buckets of one text need no comparison; a bucket's
representative is copied once for every PART rows, so that a bucket with a third of all rows
is compared in many tasks.

Defined results: null texts count as empty; the empty text has a fingerprint like any other.
Rows of equal doc_id are ordered by text; null doc_ids come last.
"""

from __future__ import annotations

import unicodedata
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkact.llm.common import broadcast_if_small, release, shuffle_partitions, written
from sparkact.llm.media import batched

PART = 512  # rows of a bucket that are compared in one task


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.casefold()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by the first as many characters of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


PASS = "kind string, part long, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def schema_of(ddl: str) -> pa.Schema:
    return pa.schema([(n, KINDS[k]) for n, k in (x.split() for x in ddl.split(", "))])


def compared(doc_id, text: str, following: str) -> tuple:
    """doc_id to near_next of PASS for a document and the one after it."""
    canon, other = canonical(text), canonical(following)
    ed = edited(text, following)
    ec = canonical(ed)
    # equal hash, then equal bytes
    h, eh = digest(canon), digest(ec)
    return doc_id, len(text), sha256(ed.encode("utf-8", "surrogatepass")).hexdigest(), h, eh, float(h == eh and canon == ec), float(h == digest(other) and canon == other)


def with_next(docs: DataFrame) -> DataFrame:
    """Each document compared with the next one in descending doc_id (after the last: the first).

    Documents are range-partitioned, so that neighbours meet inside a task; the first and last
    document of each partition are joined to those of its neighbours afterwards."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    text = F.coalesce("text", F.lit("")).alias("text")
    ordered = docs.select("doc_id", text).repartitionByRange(n, F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")

    def task(batches):
        part, schema = TaskContext.get().partitionId(), schema_of(PASS)
        held = None

        def row(doc_id, text):
            nonlocal held
            before, held = held, (doc_id, text)
            if before is None:
                return "head", part, doc_id, None, None, None, None, None, None, text
            return "done", part, *compared(*before, text), None

        yield from batched(batches, row, schema)
        if held:
            yield pa.RecordBatch.from_pylist([{"kind": "tail", "part": part, "doc_id": held[0], "text": held[1]}], schema=schema)

    passed = written(ordered.mapInArrow(task, PASS), "fingerprints")
    release(spark)
    done = passed.where("kind = 'done'").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    # One row a partition from here on: the next partition that has rows, the last one's being the first.
    parts = passed.where("kind = 'head'").select("part")
    by_part = Window.orderBy("part")
    first = F.min("part").over(by_part.rowsBetween(Window.unboundedPreceding, 0))
    following = parts.select("part", F.coalesce(F.lead("part").over(by_part), first).alias("next"))
    tails = passed.where("kind = 'tail'").select("part", "doc_id", "text")
    heads = passed.where("kind = 'head'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = tails.join(following, "part").join(heads, "next").select("doc_id", "text", "following")
    ddl = PASS.removeprefix("kind string, part long, ").removesuffix(", text string")
    return done.unionByName(ends.mapInArrow(lambda it: batched(it, compared, schema_of(ddl)), ddl))


def told_apart(digests: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, class) of documents whose text differs from the representative of
    its bucket: classes 1, 2, ... of a colliding hash. No rows as long as no hash collides."""
    buckets = digests.where("doc_id is not null").groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where("n > 1")
    members = digests.join(buckets, "fingerprint").select("doc_id", "fingerprint", "rep", F.ceil(F.col("n") / PART).alias("parts"))
    members = written(members, "buckets")
    ids = members.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids, members.count()), "doc_id", "left_semi")
    canon = F.pandas_udf(lambda s: s.map(canonical), "binary")
    own = members.dropDuplicates(["doc_id", "fingerprint"]).join(texts.select("doc_id", canon("text").alias("canon")), "doc_id")
    out, number = None, 0
    while True:
        number += 1
        salt = F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("salt")
        reps = own.where("doc_id = rep").groupBy("fingerprint", "parts").agg(F.min("canon").alias("shown")).select("fingerprint", "shown", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
        apart = own.withColumn("salt", salt).join(reps, ["fingerprint", "salt"]).where("canon <> shown").drop("salt", "shown", "rep", "parts")
        apart = written(apart, "apart")
        if apart.isEmpty():
            return out
        apart = apart.join(apart.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.ceil(F.count("*") / PART).alias("parts")), "fingerprint")
        told = apart.select("doc_id", "fingerprint", F.lit(number).alias("class"))
        out = told if out is None else out.join(told, "doc_id", "left_anti").unionByName(told)
        own = apart


RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next;
    the likeness of two exact fingerprints is 1 or 0."""
    digests = with_next(docs)
    collided = told_apart(digests.select("doc_id", "fingerprint"), docs)
    if collided is None:
        return digests.select(*RESULT)
    return digests.join(collided, ["doc_id", "fingerprint"], "left").withColumn("fingerprint", F.concat_ws("#", "fingerprint", F.col("class").cast("string"))).select(*RESULT)
