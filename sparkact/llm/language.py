"""Language identification by compression.

For each language of a labelled sample one raw-content zstandard dictionary is made of excerpts.
A text's letters (in lower case; other runs of characters become one blank) are cut into
pieces of a few thousand bytes, so that a long text can't become its own dictionary, and every
piece is compressed with each dictionary. The language whose sizes sum up smallest is predicted; it
is marked as rejected if the runner-up is within ``margin`` of it.

The fit is bounded: at most ``excerpts`` excerpts of ``excerpt_chars`` characters for a language,
from rows chosen by a hash of the doc_id, cut to ``dictionary_bytes``. Predictions take whole texts.

Defined results: texts that are null or have no letter are ``und`` with score 0, and so is every
text if no language was learnt; rows without a doc_id are not held out and not learnt from; ties go
to the language with more sampled excerpts, then by name; repeated rows are predicted alike; an
empty table gives an empty table; further columns, whatever their names, never meet the operator.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkact.llm.common import only

UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])
SLICE = 256  # rows that are held as Python strings at a time


@dataclass
class Model:
    """Dictionaries by language, in the order in which ties are settled."""

    dictionaries: dict[str, bytes]
    piece_bytes: int = 2048
    level: int = 5

    def __getstate__(self):  # compressors are made anew in each task
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    @cached_property
    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in self.dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def sizes(self, letters: str) -> dict[str, int]:
        """Compressed bytes of all pieces by language."""
        raw = letters.encode("utf-8", "surrogatepass")
        pieces = [raw[i : i + self.piece_bytes] for i in range(0, len(raw), self.piece_bytes)]
        return {lang: sum(len(c.compress(p)) for p in pieces) for lang, c in zip(self.dictionaries, self.compressors, strict=True)}

    def predict(self, letters: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the score is the language's share if each byte more halves a
        language's weight, the margin is the part of the runner-up's size that it saves."""
        if not letters or not letters.strip() or not self.dictionaries:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(letters)
        best = min(sizes, key=sizes.get)  # the first of equal ones
        rest = [n for lang, n in sizes.items() if lang != best]
        score = 1 / (1 + sum(2.0 ** -min(n - sizes[best], 60) for n in rest))
        return best, score, (min(rest) - sizes[best]) / min(rest) if rest else 1.0


def is_held_out(doc_id: Column) -> Column:
    """One document in four, by crc32 of the doc_id as text; false without a doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters_of(text: Column) -> Column:
    """Runs of letters in lower case between single blanks; null if there is no letter."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(text.rlike(r"\p{L}"), F.concat(F.lit(" "), words, F.lit(" ")))


def trained(docs: DataFrame, excerpts: int = 256, excerpt_chars: int = 1024, dictionary_bytes: int = 131_072, piece_bytes: int = 2048, level: int = 5) -> Model:
    """Dictionaries from rows with a language that are not held out. Rows are chosen before their texts
    are cut, each task keeping its first ``excerpts`` of a language; the driver gets
    at most excerpts * excerpt_chars characters for each language."""
    known = only(docs, "doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null").where(~is_held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64("doc_id", "lang")
    # a place in the text that depends on the row only; the whole text if it is short
    at = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.greatest(F.length("text") - excerpt_chars, F.lit(0)) + 1) + 1
    cut = known.select("lang", "doc_id", h.alias("h"), F.expr("text").substr(at.cast("int"), F.lit(excerpt_chars)).alias("excerpt"))
    order = W.partitionBy("lang").orderBy("h", "doc_id", "excerpt")
    chosen = cut.withColumn("k", F.row_number().over(order)).where(F.col("k") <= excerpts).select("lang", "k", letters_of(F.col("excerpt")).alias("letters"))
    held: dict[str, list[bytes]] = {}
    for r in sorted(chosen.where("letters is not null").collect(), key=lambda r: (r["lang"], r["k"])):
        held.setdefault(r["lang"], []).append(r["letters"].encode("utf-8", "surrogatepass"))
    ranked = sorted(held, key=lambda lang: (-len(held[lang]), lang))
    return Model({lang: b"".join(held[lang])[:dictionary_bytes] for lang in ranked}, piece_bytes, level)


def predicted(docs: DataFrame, model: Model, margin: float = 0.005) -> DataFrame:
    """Every row's doc_id, held_out, lang_pred, score, margin and whether it is within ``margin``;
    see PREDICTED. Nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most dictionary_bytes a language

    def task(batches):
        own = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [(*p, p[2] < margin) for p in map(own.predict, part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(SCHEMA)[2:], strict=True))], schema=SCHEMA)

    doc_id = F.col("doc_id").cast("long")
    return only(docs, "doc_id", "text").select(doc_id.alias("doc_id"), is_held_out(doc_id).alias("held_out"), letters_of(F.col("text")).alias("letters")).mapInArrow(task, PREDICTED)


def identified(docs: DataFrame, model: Model, margin: float = 0.005) -> DataFrame:
    """(doc_id, lang): the language, or ``und`` where the margin is too narrow to tell."""
    found = predicted(docs, model, margin)
    return found.select("doc_id", F.when(F.col("rejected"), UNKNOWN).otherwise(F.col("lang_pred")).alias("lang"))
