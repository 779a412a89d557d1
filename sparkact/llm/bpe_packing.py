"""Order-preserving packing of tokenised documents into windows of at most 1024 ids.

Documents stay in input order. A window may be cut at a document's end (no cost), at a
sentence's end (a small cost) or, inside sentences longer than a window, anywhere (a larger
cost). A window's padding counts in ids; one whose length is a power of two needs none. The
cuts of least total cost are found by dynamic programming over the boundaries: the least
value of ``cost[i] + position[i]`` over the boundaries within reach is kept in a monotone
queue, and each power of two is one more transition.

Each task packs the rows of its own split as they stream by; chunks of a bounded number of
ids are packed at a time, and a chunk's last window is carried into the next chunk. The cost is
the least for a chunk, so that the cuts, but never the ids, depend on how the input is split.

Ids come from the byte-level BPE vocabulary named in the parameters. Without two white-space
characters in a row a simpler pattern without look-ahead cuts a text into the same words, and
faster; texts that hold a special token's string go to the ``tokenizers`` library, whose ids
all of these equal (tests compare them).

Defined results: a null or empty text is the single id 0. Repeated rows are packed each, an empty
table has no pieces, of equal costs the cut that leaves the longer window wins, and columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SENTENCE_ENDS = tuple(x.encode() for x in ".!?\n。！？؟।…")  # fixed values
TWO_SPACES = re.compile(r"\s\s")
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


class Ids:
    """Ids of the byte-level BPE files ``json`` (tokenizers) and ``ranks`` (tiktoken), which hold one vocabulary."""

    def __init__(self, json: str, ranks: str):
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.usual, self.plain = (tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=table, special_tokens={}) for p in (public_tokenizers.PATTERN, PLAIN))
        self.json, self.library = json, None
        self.ends = np.zeros(max(table.values()) + 2, bool)  # of a sentence
        for piece, i in table.items():
            self.ends[i] = piece.rstrip(b"\"')").endswith(SENTENCE_ENDS)

    def of(self, text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.json)
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.usual if TWO_SPACES.search(text) else self.plain).encode_ordinary(text)
        return np.frombuffer(array("I", ids), "<u4")


def cuts(positions: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """Indexes of the boundaries that end windows, of least cost. ``positions``: ascending,
    the first 0, none further than ``window`` from the one before; ``costs``: of cutting there."""
    n = len(positions)
    exact: dict[int, list[int]] = {}  # boundaries from which a power of two ids lead here
    for k in (1 << b for b in range(window.bit_length() - 1)):
        i = np.searchsorted(positions, positions - k)
        for j in np.flatnonzero(positions[i] == positions - k).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    places, price = positions.tolist(), costs.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[int] = deque()  # of boundaries within reach, ascending in best + position
    value = [0] * n
    for j in range(1, n):
        p = places[j]
        v = value[j - 1]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j - 1)
        while places[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        least = value[i] + window - p
        if j in exact:
            for q in exact[j]:
                if best[q] < least:
                    least, i = best[q], q
        best[j], back[j], value[j] = least + price[j], i, least + price[j] + p
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def boundaries(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray, window: int, sentence_cost: int, hard_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and costs of the places where windows may be cut: all document ends, all sentence
    ends and, in sentences longer than a window, every place."""
    known = np.unique(np.concatenate([[0], np.flatnonzero(ends[ids]) + 1, doc_ends]))
    long = np.flatnonzero(np.diff(known) > window)
    hard = np.concatenate([np.arange(known[i] + 1, known[i + 1]) for i in long]) if len(long) else np.zeros(0, np.int64)
    positions = np.concatenate([known, hard])
    costs = np.concatenate([np.where(np.isin(known, doc_ends), 0, sentence_cost), np.full(len(hard), hard_cost)])
    order = np.argsort(positions, kind="stable")
    return positions[order], costs[order]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def packed(docs: DataFrame, json: str, ranks: str, window: int = 1024, sentence_cost: int = 2, hard_cost: int = 64, chunk_ids: int = 1_000_000) -> DataFrame:
    """The pieces of all documents; see PIECES. ``sequence_id`` is unique over the table."""

    def task(batches):
        ids, number = Ids(json, ranks), TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # (doc_id, ids from the first one not yet packed, all its ids' number)

        def pack(last: bool):
            """Rows for ``held``; unless ``last``, what the final window holds stays in ``held``."""
            nonlocal number, held
            stream = np.concatenate([h[1] for h in held])
            positions, costs = boundaries(stream, ids.ends, np.cumsum([len(h[1]) for h in held]), window, sentence_cost, hard_cost)
            ends = [int(positions[j]) for j in cuts(positions, costs, window)]
            stop = ends[-1] if last or len(ends) < 2 else ends[-2]
            rows, e, offset, at, rest = [], 0, 0, 0, []
            for doc_id, own, total in held:
                n, done, raw = len(own), 0, memoryview(own).cast("B")
                while done < n and at < stop:
                    size = min(n - done, ends[e] - at)
                    rows.append((doc_id, total - n + done, size, zlib.crc32(raw[4 * done : 4 * (done + size)]), total, number, offset))
                    at, done, offset = at + size, done + size, offset + size
                    if at == ends[e]:
                        e, offset, number = e + 1, 0, number + 1
                if done < n:
                    rest.append((doc_id, own[done:], total))
            held = rest
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=SCHEMA)

        waiting, end = 0, np.zeros(1, "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    own = np.concatenate([ids.of(text or ""), end])
                    held.append((doc_id, own, len(own)))
                    waiting += len(own)
                    if waiting >= chunk_ids:
                        yield pack(False)
                        waiting = sum(len(h[1]) for h in held)
        if held:
            yield pack(True)

    return docs.select("doc_id", "text").mapInArrow(task, PIECES)
