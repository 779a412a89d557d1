"""The best rows of one block of vectors for one block of query vectors, for tasks that score all pairs block by block.

A product of matrices in single precision gives every cosine with a known error; what may be among the best within
that error is scored again in double precision, summed in the order in which :func:`sparkact.functions.vectors.dot` sums,
so that a score depends on its two vectors alone and nothing is lost."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 256  # queries scored at a time


class Side(NamedTuple):
    """Vectors of one length: their rows, the values by dimension, their norms, which have a null value, and unit vectors in single precision."""

    rows: np.ndarray
    values: np.ndarray
    norms: np.ndarray
    empty: np.ndarray
    units: np.ndarray
    odd: np.ndarray


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of columns, summed from the first dimension on."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def by_width(column: pa.ChunkedArray) -> dict[int, Side]:
    """Vectors of equal length together; null ones are left out."""
    column = pa.chunked_array(column).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    out = {}
    for width in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        empty = np.asarray(pc.is_null(flat)).reshape(len(rows), width).any(axis=1)
        values = np.ascontiguousarray(np.asarray(pc.fill_null(flat, 0.0)).reshape(len(rows), width).T)
        with np.errstate(all="ignore"):
            norms = np.sqrt(folded(values, values))
            odd = (norms != 0) & ~((norms > 1e-150) & (norms < 1e150))  # whose cosines single precision says nothing about
            units = (values / np.where(odd | (norms == 0), np.inf, norms)).T
        out[width] = Side(rows, values, norms, empty, np.where(odd[:, None], 0.0, units).astype(np.float32), odd)
    return out


def first_copies(v: Side, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the vectors without those that ``k`` equal ones come before: no query has more of them among its best."""
    if not len(v.values) or len(order) <= k:
        return np.arange(len(order))
    as_bytes = np.ascontiguousarray(v.values.T).view(np.dtype((np.void, 8 * len(v.values)))).ravel()
    same = np.unique(as_bytes, return_inverse=True)[1].ravel() * 2 + v.empty
    at = np.lexsort((order, same))
    first = np.flatnonzero(np.concatenate(([True], np.diff(same[at]) != 0)))
    return np.sort(at[np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) < k])


def best(order: np.ndarray, vectors: pa.ChunkedArray, queries: pa.ChunkedArray, k: int, floor: float | None = None, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of the query, row of the vector, cosine) of each query's ``k`` best: greatest cosine first (compared by
    ``digits``, if given), then least ``order``. Vectors of different lengths don't meet. A vector of length 0 has
    cosine 0, one with a null value has none and comes last; what is no number comes first. With ``floor`` only
    cosines of at least that much count."""
    found, left = [], by_width(vectors)
    for width, q in by_width(queries).items():
        if width not in left:
            continue
        v = left[width]
        keep = first_copies(v, order[v.rows], k)
        v = Side(v.rows[keep], v.values[:, keep], v.norms[keep], v.empty[keep], v.units[keep], v.odd[keep])
        margin = 2.5e-7 * (width + 8) + (0 if digits is None else 10.0**-digits)
        for start in range(0, len(q.rows), STEP):
            at = slice(start, start + STEP)
            rough = q.units[at] @ v.units.T
            rough[:, v.odd] = np.inf
            rough[q.odd[at]] = np.inf
            rough[:, v.empty] = -np.inf
            rough[q.empty[at]] = -np.inf
            least = np.full(len(rough), -np.inf if floor is None else floor - margin)
            if rough.shape[1] > k:
                least = np.maximum(least, np.partition(rough, -k, axis=1)[:, -k] - np.float32(margin))
            i, j = np.nonzero(rough >= least[:, None].astype(np.float32))
            none = v.empty[j] | q.empty[at][i]
            with np.errstate(all="ignore"):
                total = np.zeros(len(i))
                for x, y in zip(q.values[:, at], v.values, strict=True):
                    total += x[i] * y[j]
                lengths = v.norms[j] * q.norms[at][i]
                score = np.where(lengths == 0, 0.0, total / lengths)
            if floor is not None:
                fits = (score >= floor) & ~none
                i, j, none, score = i[fits], j[fits], none[fits], score[fits]
            rank = np.where(none, -np.inf, np.where(np.isnan(score), np.inf, score if digits is None else np.round(score, digits)))
            by = np.lexsort((order[v.rows[j]], -rank, i))
            i, j, none, score = i[by], j[by], none[by], score[by]
            first = np.flatnonzero(np.concatenate(([True], np.diff(i) != 0))) if len(i) else np.zeros(0, np.int64)
            top = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
            found.append((q.rows[at][i[top]], v.rows[j[top]], score[top], none[top]))
    rows, hits, scores, none = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
    return rows, hits, pa.array(scores, pa.float64(), mask=none)
