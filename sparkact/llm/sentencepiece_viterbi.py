"""SentencePiece encoding and decoding by a streaming Viterbi search.

Pieces and their scores come from a public model file. A text (normalised by the model's own
rules) is segmented into the pieces of greatest total score, read from left to right: whenever
two longest pieces are in the window, the backpointer paths of all boundaries that a further
piece can start from are followed back, and the ids before the boundary in which they converge
are committed and forgotten. So the window holds three longest pieces, or more only where the
paths have not converged.
Characters that no piece covers become byte pieces if the model has them, else the unknown id.

No piece of such a model holds a word start behind another character, so every word start is
a boundary of this kind; what the search commits for short words is kept in a bounded cache.

Ids equal those of the library's unigram encoder over the same pieces and scores (tested). The
file's pieces were learnt by merging, and their scores are merge ranks: the ids are those of
greatest total score, not those that merging gives. Defined results: null and empty texts have no
ids and decode to the empty text; repeated rows have equal results, an empty table none, and of
pieces of equal score the one that starts first wins; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkact.llm.media import batched

WORD = re.compile("▁+[^▁]*|[^▁]+")
UNKNOWN_PENALTY = 10.0


class Pieces:
    """The pieces of one model file, and the search over them."""

    def __init__(self, path: str, most: int = 600_000):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        usual = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in usual}
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in usual}
        self.longest = max(map(len, self.ids), default=1)
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.trie: dict = {}  # character -> [score or None, id, what may follow]
        for p, i in self.ids.items():
            at = self.trie
            for ch in p[:-1]:
                at = at.setdefault(ch, [None, -1, {}])[2]
            if p:
                at.setdefault(p[-1], [None, -1, {}])[:2] = self.scores[p], i
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.unknown = m.unk_id()
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.words = not any("▁" in p.lstrip("▁") for p in self.ids)
        of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        control = {i for i in range(n) if m.is_control(i)}
        self.spelled = [of_byte.get(i, b"" if i in control else m.id_to_piece(i).replace("▁", " ").encode() if i != self.unknown else " \u2047 ".encode()) for i in range(n)]
        self.most, self.cache = most, {}
        self.window = 0  # the widest so far, for tests

    def normal(self, text: str) -> str:
        return self.model.normalize(text)

    def search(self, text: str):
        """Ids of ``text``, yielded in the runs in which they are committed."""
        base, n, longest, scores, prefixes, unknown = 0, len(text), self.longest, self.scores, self.prefixes, self.unknown_score
        width = 2 * longest - 1
        best: list = [0.0] + [None] * min(n, width + longest)  # of the boundaries base, base + 1, ...
        back = [0] * len(best)
        for at in range(n):
            if at - base >= width:
                # follow every live boundary back; they have converged where one boundary is left
                live = {at + k for k, b in enumerate(best[at - base :]) if b is not None}
                while len(live) > 1:
                    far = max(live)
                    live.discard(far)
                    live.add(back[far - base])
                if (meet := live.pop()) > base:
                    yield self.path(text, base, meet, back)
                    gone = meet - base
                    best, back, base = best[gone:], back[gone:], meet
                room = min(n - base, max(width, at - base) + longest) + 1 - len(best)
                best += [None] * room
                back += [0] * room
                self.window = max(self.window, len(best))
            score, end = best[at - base], at + 1
            while end <= n:
                piece = text[at:end]
                s = scores.get(piece)
                if s is not None:
                    b = best[end - base]
                    if b is None or score + s > b:
                        best[end - base], back[end - base] = score + s, at
                elif piece not in prefixes:
                    break
                end += 1
            if text[at] not in scores:
                s, b = score + unknown, best[at + 1 - base]
                if b is None or s > b:
                    best[at + 1 - base], back[at + 1 - base] = s, at
        if n > base:
            yield self.path(text, base, n, back)

    def path(self, text: str, base: int, end: int, back: list) -> list[int]:
        out: list[int] = []
        while end > base:
            start = back[end - base]
            i = self.ids.get(text[start:end])
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[start:end].encode())]
            else:
                out.append(self.unknown)
            end = start
        return out[::-1]

    def short(self, word: str) -> list[int]:
        """Ids of a word without a window: the same search over a tree of the pieces' characters."""
        n, trie, unknown = len(word), self.trie, self.unknown_score
        best, back, which = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            score, end, next_ = best[at], at, trie
            for ch in word[at:]:
                hit = next_.get(ch)
                if hit is None:
                    break
                end += 1
                s, i, next_ = hit
                if s is not None and score + s > best[end]:
                    best[end], back[end], which[end] = score + s, at, i
            hit = trie.get(word[at])
            if (hit is None or hit[0] is None) and score + unknown > best[at + 1]:
                best[at + 1], back[at + 1], which[at + 1] = score + unknown, at, -1
        out: list[int] = []
        end = n
        while end:
            start = back[end]
            if which[end] >= 0:
                out.append(which[end])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(word[start:end].encode())]
            else:
                out.append(self.unknown)
            end = start
        return out[::-1]

    def packed(self, word: str) -> bytes:
        short = len(word) < 64
        out = b"".join([array("I", run).tobytes() for run in ([self.short(word)] if short else self.search(word))])
        if short:
            if len(self.cache) >= self.most:
                self.cache.clear()
            self.cache[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.of_normal(self.normal(text or ""))

    def of_normal(self, text: str) -> bytes:
        """Ids of a text that is normalised."""
        cut = WORD.findall(text) if self.words else [text]
        get, packed = self.cache.get, self.packed
        return b"".join([get(w) or packed(w) for w in cut])

    def decode(self, ids: bytes) -> str:
        """The normalised text without the space that the model puts before it."""
        raw = b"".join(map(self.spelled.__getitem__, memoryview(ids).cast("I")))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Ids of every text: doc_id, ids array<int>."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def task(batches):
        pieces = Pieces(model)
        yield from batched(batches, lambda d, t: (d, np.frombuffer(pieces.encode(t), "<i4")), schema)

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """Texts of the rows of :func:`encoded`: doc_id, text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def task(batches):
        pieces = Pieces(model)
        yield from batched(batches, lambda d, i: (d, pieces.decode(np.array(i or [], "<u4").tobytes())), schema)

    return ids.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


TRIPS = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """Every text encoded and decoded again; see TRIPS. ``round_trip``: the decoded text is the
    normalised one."""
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in TRIPS.split(", "))])

    def task(batches):
        pieces = Pieces(model)

        def row(doc_id, text):
            normal = pieces.normal(text or "")
            ids = pieces.of_normal(normal)
            back = pieces.decode(ids)
            same = back == normal.replace("▁", " ").removeprefix(" ")
            return doc_id, len(ids) // 4, zlib.crc32(ids), sha256(back.encode()).hexdigest(), same

        yield from batched(batches, row, schema)

    return docs.select("doc_id", "text").mapInArrow(task, TRIPS)
