"""Names of helper columns that no column of the caller's has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(stem: str, *frames: DataFrame) -> str:
    taken = {c.lower() for f in frames for c in f.columns}
    while stem in taken:
        stem += "_"
    return stem
