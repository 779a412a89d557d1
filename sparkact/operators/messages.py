"""Versioned message ingestion: identity, versions, source precedence, denials, provenance,
chunks."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkact.functions import text as tx
from sparkact.functions.names import fresh


def versions(messages: DataFrame, identity: list[str]) -> DataFrame:
    """Immutable versions: rows of one identity and content are one version; numbered in order
    of first appearance."""
    hashed = messages.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    once = hashed.groupBy(*identity, "content_hash").agg(F.min("created_at_ms").alias("first_ms"), F.count("*").alias("copies"))
    return once.withColumn("version", F.row_number().over(Window.partitionBy(*identity).orderBy("first_ms", "content_hash")))


def winners(rows: DataFrame, identity: list[str], precedence: list[str], payload: list[str]) -> DataFrame:
    """The row of greatest precedence by identity; later names decide ties."""
    row = fresh("_row", rows)
    best = rows.groupBy(*identity).agg(F.max(F.struct(*precedence, *[c for c in payload if c not in precedence])).alias(row))
    return best.select(*identity, *[F.col(row)[c].alias(c) for c in payload])


def allowed(rows: DataFrame, denials: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(denials.select(*keys).distinct(), keys, "left_anti")


def with_full_provenance(chunks: DataFrame, members: DataFrame, sources: DataFrame, chunk: str, member: str) -> DataFrame:
    """Chunks all of whose members have at least one good source (relational division)."""
    bad = members.join(sources.select(member).distinct(), member, "left_anti").select(chunk).distinct()
    return chunks.join(bad, chunk, "left_anti")


def in_scope(rows: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(scope.select(*keys), keys, "left_semi")


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only, with the side."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer").where("l is null or r is null")
    return both.select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert: of rows with equal keys the one of the greatest version, new before old, then the one greatest by
    the other columns, in their order."""
    side, place = fresh("_new", old, new), fresh("_rn", old, new)
    rows = old.withColumn(side, F.lit(0)).unionByName(new.withColumn(side, F.lit(1)))
    others = [F.desc(f.name) for f in old.schema.fields if f.name not in (*keys, version) and "map<" not in f.dataType.simpleString()]
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc(side), *others)
    return rows.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place, side)


def carried_over(parent: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A partial import's members, with those of its parent that it doesn't cover."""
    return new.unionByName(parent.join(new.select(*keys), keys, "left_anti"))


def gap_chunks(messages: DataFrame, gap_ms: int) -> DataFrame:
    """Chunks by time gap only."""
    w = Window.partitionBy("conversation").orderBy("created_at_ms", "ordinal")
    new = F.coalesce((F.col("created_at_ms") - F.lag("created_at_ms").over(w) > gap_ms).cast("int"), F.lit(1))
    marked = messages.withColumn("new", new).withColumn("chunk", F.sum("new").over(w))
    return marked.groupBy("conversation", "chunk").agg(F.count("*").alias("n"), F.min("created_at_ms").alias("started_ms"), F.max("created_at_ms").alias("ended_ms"), F.sum(F.octet_length("content")).alias("bytes"))


CHUNKS = "conversation long, chunk_index int, first_ordinal long, last_ordinal long, messages int, bytes int, started_ms long, ended_ms long, content string"
CHUNKS_SCHEMA = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in (x.split() for x in CHUNKS.split(", "))])


def chunks(messages: DataFrame, most_bytes: int = 512, most: int = 40, gap_ms: int = 1_800_000, overlap: int = 2) -> DataFrame:
    """Chunks of each conversation's messages: closed by a time gap, a byte budget or a number of
    messages. After a split by size the next chunk repeats up to ``overlap`` messages that fit.
    The state depends on order: conversations stream by in order, and a task holds the open chunk
    only, of at most ``most`` messages. A conversation is one task's work, of any length."""
    order = [F.col("conversation"), F.col("created_at_ms").asc_nulls_last(), F.col("ordinal").asc_nulls_last()]
    rows = messages.select("conversation", "ordinal", "created_at_ms", "content").repartition("conversation").sortWithinPartitions(*order)

    def closed(batches):
        """The rows of CHUNKS."""
        current, index, held, sizes, fresh = (), 0, [], 0, 0  # sizes: the sum of the held messages'

        def row() -> tuple:
            return current[0], index, held[0][0], held[-1][0], len(held), sizes + len(held) - 1, held[0][1], held[-1][1], "\n".join(m[2] for m in held)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for conversation, ordinal, ms, content in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    content = content or ""
                    size = len(content.encode())
                    if (conversation,) != current:
                        if fresh:
                            yield row()
                        current, index, held, sizes, fresh = (conversation,), 0, [], 0, 0
                    if held and None not in (ms, held[-1][1]) and ms - held[-1][1] > gap_ms:
                        if fresh:
                            yield row()
                            index += 1
                        held, sizes, fresh = [], 0, 0
                    if held and (len(held) >= most or sizes + len(held) + size > most_bytes):
                        if fresh:
                            yield row()
                            index += 1
                        held, fresh = held[-overlap:] if overlap else [], 0
                        sizes = sum(m[3] for m in held)
                        while held and sizes + len(held) + size > most_bytes:
                            sizes -= held[0][3]
                            held = held[1:]
                    held.append((ordinal, ms, content, size))
                    sizes += size
                    fresh += 1
        if fresh:
            yield row()

    def task(batches):
        found = closed(batches)
        while part := list(islice(found, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), CHUNKS_SCHEMA, strict=True)], schema=CHUNKS_SCHEMA)

    return rows.mapInArrow(task, CHUNKS)


def todos(messages: DataFrame, cap: int = 80) -> DataFrame:
    """To-do phrases, the first of each wording."""
    found = messages.select("conversation", "ordinal", F.explode(F.regexp_extract_all("content", F.lit(tx.TODO), 1)).alias("title"))
    named = found.withColumn("title", F.substring(tx.normal_space(F.col("title")), 1, cap)).withColumn("key", F.lower("title"))
    w = Window.partitionBy("key").orderBy("conversation", "ordinal")
    return named.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("conversation", "ordinal", "title")
