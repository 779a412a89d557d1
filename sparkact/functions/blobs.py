"""Vectors as bytes: float32, little end first, without a step for each row.

An Arrow array of lists and one of binaries hold the same bytes, so a codec only gives them other
offsets; bytes move only where a binary has a tail that is no whole number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def to_bytes(x: pa.Array) -> pa.Array:
    """Lists of float32 as binaries; a null list, or one with a null in it, is null."""
    sizes = np.asarray(x.value_lengths().fill_null(0), np.int64)
    values = x.flatten()  # without what stands under null lists
    flat = np.ascontiguousarray(np.asarray(values.fill_null(0.0)), dtype="<f4")
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    good = np.asarray(x.is_valid())
    if values.null_count:
        owner = np.repeat(np.arange(len(x)), sizes)
        good = good & ~np.bincount(owner, np.asarray(values.is_null()), len(x)).astype(bool)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [pa.array(good).buffers()[1], pa.py_buffer(offsets * 4), pa.py_buffer(flat)]).cast(pa.binary())


def to_floats(x: pa.Array) -> pa.Array:
    """Binaries as lists of float32; up to three bytes at an end are dropped."""
    sizes = np.asarray(pc.binary_length(x).fill_null(0), np.int64)
    x = x.fill_null(b"")
    starts = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x)].astype(np.int64) if len(x) else np.zeros(0, np.int64)
    raw = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] else np.zeros(0, np.uint8)
    raw = raw[starts[0] : starts[-1] + sizes[-1]] if len(x) else raw
    whole = sizes // 4 * 4
    if (whole != sizes).any():
        place = np.arange(len(raw)) - np.repeat(starts - starts[0], sizes)
        raw = raw[place < np.repeat(whole, sizes)]
    offsets = np.concatenate(([0], np.cumsum(whole // 4))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(raw.tobytes(), "<f4").astype(np.float32)))


@arrow_udf(T.BinaryType())
def _encoded(x: pa.Array) -> pa.Array:
    return to_bytes(x)


@arrow_udf(T.ArrayType(T.FloatType()))
def _decoded(x: pa.Array) -> pa.Array:
    return to_floats(x)


def encoded(vector: Column) -> Column:
    """An array of floats as bytes; null for a null array or one that holds a null."""
    return _encoded(vector.cast("array<float>"))


def decoded(blob: Column) -> Column:
    """Bytes as an array of floats, without the bytes of a number that was cut off; null stays null."""
    return F.when(blob.isNotNull(), _decoded(F.coalesce(blob, F.lit(b""))))


def decoded_exactly(blob: Column, dimension: int) -> Column:
    """The ``dimension`` floats of a blob of just their length; null for any other, or for one with a number that
    is not finite."""
    found = decoded(blob)
    finite = F.forall(found, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when((F.octet_length(blob) == 4 * dimension) & finite, found)
