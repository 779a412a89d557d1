"""Fill-in-the-middle: a text becomes prefix, suffix and middle, set apart by sentinels.

A text's UTF-8 bytes are classed by ``bytes.translate`` into the digits of one big integer, bit i
for byte i. Shifts and boolean operations on such masks mark where units begin, ``bit_count``
says how many there are, and the place of the k-th one is found by halving the mask again and
again, so that no step loops over characters or units in Python.

Units are lines (``[^\\n]*\\n|[^\\n]+``), words (a run of blanks with the rest up to the next run)
or characters; joined together they give the text. A null text counts as an empty one, an empty
text or one that holds a sentinel stays as it is (form ``plain``). A null doc_id is drawn for as
the empty string. Repeated rows are drawn alike, each keeps its row; an empty table gives an empty
table; further columns, whatever their names, never meet the operator.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkact.llm.common import only

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
SLICE = 256  # rows that are held as Python strings at a time


def digits(members: bytes) -> bytes:
    """A table for ``translate``: the digit 1 for these bytes, 0 for others."""
    return bytes(49 if b in members else 48 for b in range(256))


NEWLINE = digits(b"\n")
BLANK = digits(b" \t\n\x0b\x0c\r")
FIRST = digits(bytes(b for b in range(256) if b & 0xC0 != 0x80))  # of a character


def mask(raw: bytes, table: bytes) -> int:
    """Bit i is set if byte i is of the class."""
    return int(raw.translate(table)[::-1], 2) if raw else 0


def starts(raw: bytes, unit: str) -> int:
    """Bit i is set if a unit begins at byte i."""
    full = (1 << len(raw)) - 1
    if unit == "line":
        return (mask(raw, NEWLINE) << 1 | 1) & full
    if unit == "word":
        blank = mask(raw, BLANK)
        return (blank & ~(blank << 1) | 1) & full
    if unit == "char":
        return mask(raw, FIRST)
    raise ValueError(f"unknown unit {unit}")


def select(marks: int, rank: int, size: int) -> int:
    """The place of set bit ``rank`` (from 0, below ``size``); ``size`` if there are fewer."""
    if rank >= marks.bit_count():
        return size
    at = 0
    while size > 1:
        half = size >> 1
        low = marks & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            marks, size = low, half
        else:
            marks, size, rank, at = marks >> half, size - half, rank - below, at + half
    return at


def transformed_text(text: str | None, draws: list[int], fim_percent: int = 100, spm_percent: int = 50, unit: str = "line") -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) for four draws."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    marks = starts(raw, unit)
    n = marks.bit_count()
    if not raw or PREFIX in text or SUFFIX in text or MIDDLE in text or draws[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    first, second = (select(marks, k, len(raw)) for k in sorted(d % (n + 1) for d in draws[:2]))
    chars = mask(raw, FIRST)
    before, inside = ((chars & ((1 << p) - 1)).bit_count() for p in (first, second))
    prefix, middle, suffix = (p.decode("utf-8", "surrogatepass") for p in (raw[:first], raw[first:second], raw[second:]))
    if draws[3] % 100 < spm_percent:
        return n, "spm", before, inside - before, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", before, inside - before, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned numbers: the first four groups of eight digits of the hex SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def transformed(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, unit: str = "line") -> DataFrame:
    """Every row's doc_id, units, form, sizes and output; see FORMS. ``fim_percent`` of the texts are cut, ``spm_percent`` of
    these begin with the suffix. Nothing is shuffled; a task holds SLICE texts at a time."""

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [transformed_text(t, d, fim_percent, spm_percent, unit) for t, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), list(SCHEMA)[1:], strict=True))], schema=SCHEMA)

    doc_id = F.col("doc_id").cast("long")
    return only(docs, "doc_id", "text").select(doc_id.alias("doc_id"), "text", draws(doc_id, seed).alias("draws")).mapInArrow(task, FORMS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. As a cut text holds no sentinel, each sentinel
    stands in its output once."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
