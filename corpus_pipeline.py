"""A corpus pipeline: toxic documents go, then repeated lines, then all but one of each group
of near-duplicates, then repeated passages; what is left is packed for training.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns
of ``documents``. ``run`` writes each stage's result and reads it again for the next.

Defined results: a text of which lines or passages go keeps the rest, an empty text if nothing
is left, and its ``n_chars`` follows. Null and empty texts pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkact.llm import bpe_packing, line_join, ngram_join, suffix_dedup, toxicity
from sparkact.llm.common import table, written
from sparkact.llm.queries import tokenizer_file

ORACLE_SQL = None


def counted(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names``, with n_chars (if there is one) that of the text as it is now."""
    return df.select(*[F.length("text").cast("long").alias(n) if n == "n_chars" else F.col(f"`{n}`") for n in names])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(line_join.deduplicated(docs, exact=1), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(suffix_dedup.without_repeats(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_packing.packed(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("suffix_dedup", passage_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
