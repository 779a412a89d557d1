"""Key-wise resolution of very many small entries, packed into binary rows.

A map task turns its rows into arrays of entries, settles among its own entries whatever it
can, and sends the rest packed by hash range of the key; a reduce task sees all entries of a
range. As a task sends a key at most once for each smallest document it has seen, a key that
stands in a third of all rows costs a reduce task one entry a map task, not one a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkact.llm.common import shuffle_partitions

PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
PACKED_DDL = "bucket int, kind int, payload binary"
SUB_BUCKETS = 4  # a reduce task holds one of these at a time


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of equal length as byte planes, so that unused high bytes compress away."""
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)


def unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(data) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        planes = np.frombuffer(data, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(k))
        at += n * w
    return out


def rows_of(kind: int, key: np.ndarray, arrays: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Packed rows of the entries, one for each bucket of ``key`` (uint64) that has any."""
    b = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    edges = np.searchsorted(b[order], np.arange(buckets + 1))
    sorted_arrays = [a[order] for a in arrays]
    for i in np.flatnonzero(np.diff(edges)).tolist():
        yield i, kind, pack([a[edges[i] : edges[i + 1]] for a in sorted_arrays])


def record_batches(rows: Iterator[tuple[int, int, bytes]], size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), PACKED, strict=True)], schema=PACKED)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), PACKED, strict=True)], schema=PACKED)


def exchanged(df: DataFrame, map_task: Callable, reduce_bucket: Callable, ddl: str) -> DataFrame:
    """``map_task(batches, buckets)`` yields (bucket, kind, payload); ``reduce_bucket(payloads by
    kind)`` gets all of a bucket's and yields Arrow batches of the schema ``ddl``."""
    buckets = shuffle_partitions(df.sparkSession) * SUB_BUCKETS
    return reduced(df.mapInArrow(lambda it: record_batches(map_task(it, buckets)), PACKED_DDL), reduce_bucket, ddl)


def reduced(sent: DataFrame, reduce_bucket: Callable, ddl: str) -> DataFrame:
    """The second half of :func:`exchanged`, for packed rows; also for what a first one yields."""
    n = shuffle_partitions(sent.sparkSession)

    def reduce_task(batches):
        current, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column(0)[i].as_py()
                if bucket != current:
                    if held:
                        yield from reduce_bucket(held)
                    current, held = bucket, {}
                held.setdefault(batch.column(1)[i].as_py(), []).append(batch.column(2)[i].as_py())
        if held:
            yield from reduce_bucket(held)

    return sent.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket").mapInArrow(reduce_task, ddl)


def all_of(payloads: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    parts = [unpack(p, kinds) for p in payloads]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def first_of_runs(*sorted_arrays: np.ndarray) -> np.ndarray:
    """True where one of the arrays, sorted together, changes."""
    n = len(sorted_arrays[0])
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for a in sorted_arrays:
            out[1:] |= a[1:] != a[:-1]
    return out
