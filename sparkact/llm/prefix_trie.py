"""The trie of conversations that begin alike, and what sharing their beginnings saves.

Every conversation is first rebuilt: ``h`` (0 to 3, by the checksum of its id) turns of the
conversation at the start of its block of twenty, then its own turns after the first ``h``. A node
is a distinct sequence of first turns. Its digest is the exclusive or of 128-bit hashes of (place,
turn), so that the digests of all beginnings are a running aggregate (``operators.running``) that
no long conversation puts into one task, and the parent's digest is an exclusive or away. A node's
turn is known by its SHA-256; that all members of a digest have one parent and one turn, and so by
induction the same turns, is verified.

Sums over subtrees are pointer jumping: in round k every node adds its sums to its ancestor 2**k
above and learns the one 2**(k+1) above, so that a conversation of n turns needs log2(n) rounds.

Defined results: turns are ordered by turn (null first), then role, then the text's first 64
characters, then the SHA-256 of both; null role or text is empty; rows without conv_id belong to
no conversation; repeated rows are turns of their own; an empty table has no node, not even the
root. Further columns, whatever their names, never meet the operator.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkact.llm.common import only, shuffle_partitions, written
from sparkact.operators.running import running

BLOCK = 20  # conversations share the first turns of the one whose id is a multiple of this
MOST_SHARED = 4  # a conversation takes less than this many turns
IDS_IN_A_ROW = 8192
WORDS = r"[^\x20\x09-\x0D]+"
NODE = ["hi", "lo"]


def place_hash(lane: int) -> Column:
    return F.xxhash64(F.lit(lane), "depth", "key")


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, key, words) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = only(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), key.alias("key"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    return running(turns, ["conv_id"], ["turn", "role", "head", "key"], {"pos": ("count", F.lit(1))}).select("conv_id", "pos", "key", "words")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, total) of the rebuilt conversations, and (conv_id, total, depth from 1, key, words) of their turns."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    first = own.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < MOST_SHARED))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("first"))  # less than MOST_SHARED
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n_own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % BLOCK})
    convs = convs.join(first, "base", "left").withColumn("taken", F.when(F.col("first").isNull() | (F.col("h") == 0), F.expr("slice(first, 1, 0)")).otherwise(F.expr("slice(first, 1, int(h))")))
    convs = convs.withColumn("k", F.when(F.col("taken").isNull(), 0).otherwise(F.size("taken")).cast("long"))
    convs = written(convs.withColumn("total", F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).select("conv_id", "h", "k", "total", "taken"), "convs")
    shared = convs.select("conv_id", "total", F.explode("taken").alias("t")).select("conv_id", "total", F.col("t.pos").alias("depth"), "t.key", "t.words")
    rest = own.join(convs.drop("taken"), "conv_id").where("pos > h").select("conv_id", "total", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "key", "words")
    return convs.select("conv_id", "total"), shared.unionByName(rest)


def members(conversations: DataFrame) -> DataFrame:
    """A row for each rebuilt conversation and node it belongs to: the node's digest, its parent's, the turn."""
    convs, turns = rebuilt(written(own_turns(conversations), "turns"))
    turns = turns.withColumns({"a": place_hash(1), "b": place_hash(2)})
    turns = running(turns, ["conv_id"], ["depth"], {"hi": ("xor", "a"), "lo": ("xor", "b")})
    below = turns.select("conv_id", "total", "depth", "hi", "lo", F.expr("hi ^ a").alias("phi"), F.expr("lo ^ b").alias("plo"), "key", "words")
    zero, none = F.lit(0).cast("long"), F.lit(None)
    root = convs.select("conv_id", "total", zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), none.cast("long").alias("phi"), none.cast("long").alias("plo"), none.cast("string").alias("key"), zero.alias("words"))
    return below.unionByName(root)


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row a node. Raises if a digest stands for two sequences of turns."""
    same = ("depth", "phi", "plo", "key")
    out = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        *[F.min(c).alias(c) for c in same], F.max(F.struct(*same)).alias("most"), F.min(F.struct(*same)).alias("least"),
    )
    out = written(out, "nodes")
    if not out.where(~F.col("most").eqNullSafe(F.col("least"))).isEmpty():
        raise RuntimeError("two sequences of turns share a digest")
    kids = out.where("depth > 0").groupBy("phi", "plo").agg(F.count("*").alias("n_children")).select(F.col("phi").alias("hi"), F.col("plo").alias("lo"), "n_children")
    n_children = F.coalesce("n_children", F.lit(0)).cast("long")
    return written(out.drop("most", "least", "key").join(kids, NODE, "left").withColumn("n_children", n_children), "nodes-children")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(hi, lo, parent_conv_id, n_leaves, saved_tokens) by pointer jumping."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    no_id = F.lit(None).cast("long")
    state = nodes.select(*NODE, "depth", "conv_id", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.col("phi").alias("jhi"), F.col("plo").alias("jlo"), no_id.alias("parent"))
    step = 1
    while step <= deepest:
        jumping = state.where(F.col("depth") >= step)
        given = jumping.groupBy("jhi", "jlo").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        given = given.select(F.col("jhi").alias("hi"), F.col("jlo").alias("lo"), "leaves", "saved")
        # only who has an ancestor twice as far needs its pointer moved; in the first round all learn their parent's conv_id
        movers = jumping.where(F.col("depth") >= (1 if step == 1 else 2 * step)).select(*NODE, F.col("jhi").alias("th"), F.col("jlo").alias("tl"))
        targets = state.select(F.col("hi").alias("th"), F.col("lo").alias("tl"), "jhi", "jlo", *([F.col("conv_id").alias("parent")] if step == 1 else []))
        moved = movers.join(targets, ["th", "tl"]).drop("th", "tl")
        kept = state.select(*NODE, "depth", "conv_id", "leaves", "saved", "parent")
        rows = kept.unionByName(given, allowMissingColumns=True).unionByName(moved, allowMissingColumns=True)
        total = [F.sum(c).alias(c) for c in ("leaves", "saved")]
        state = written(rows.groupBy(*NODE).agg(F.max("depth").alias("depth"), F.max("conv_id").alias("conv_id"), *total, *[F.max(c).alias(c) for c in ("jhi", "jlo", "parent")]), "jumps")
        step *= 2
    return state.select(*NODE, F.col("parent").alias("parent_conv_id"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


IDS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())])


def ended(batches, schema: pa.Schema, begin, add, end):
    """Runs of rows with equal (hi, lo), in which ``add`` keeps a bounded state; rows of ``schema`` from ``end``."""
    node, state, out = None, None, []
    for batch in batches:
        for hi, lo, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (hi, lo) != node:
                if node is not None:
                    out += end(node, state)
                node, state = (hi, lo), begin()
            out += add(node, state, *rest)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
            out = []
    if node is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in end(node, state)], schema=schema)


def joined_ids(batches):
    def add(node, state, conv_id):
        state.append(conv_id)
        return flush(node, state) if len(state) == IDS_IN_A_ROW else []

    def flush(node, state):
        out = [(*node, state[0], ",".join(map(str, state)))] if state else []
        state.clear()
        return out

    return ended(batches, IDS, list, add, flush)


def hashed_ids(batches):
    def add(node, state, first, ids):
        if state:
            state[0].update(b",")
        else:
            state.append(sha256())
        state[0].update(ids.encode())
        return []

    return ended(batches, DIGESTS, list, add, lambda node, state: [(*node, state[0].hexdigest())])


def end_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a node. The ids of a node with very many are
    sorted and joined by ranges first, so that one task hashes a few thousand ids a row."""
    n = shuffle_partitions(rows.sparkSession)
    ends = written(rows.where("depth = total").select(*NODE, "conv_id"), "ends")
    pieces = ends.repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(joined_ids, "hi long, lo long, first long, ids string")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed_ids, "hi long, lo long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = written(members(conversations), "members")
    nodes = nodes_of(rows)
    out = nodes.join(rolled_up(nodes), NODE).join(end_digests(rows), NODE, "left")
    nothing = F.lit(sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
