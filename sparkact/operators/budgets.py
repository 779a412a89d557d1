"""Budgets over ordered rows of any number: what fits, and what goes first where too much is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkact.operators.running import running


def within(rows: DataFrame, keys: list[str], order: list[Column | str], size: str, budget: int) -> DataFrame:
    """The rows of each key up to the first with which the sizes exceed ``budget``, with the sum so far (``used``).
    Sizes are not negative; a null size is 0. No key is held in one task."""
    return running(rows, keys, order, {"used": ("sum", F.coalesce(F.col(size), F.lit(0)).cast("long"))}).where(F.col("used") <= budget)


def retained(rows: DataFrame, age: list[Column | str], size: str, most: int, since: Column | None = None) -> DataFrame:
    """What a sweep leaves: the rows that aren't older than ``since`` (a condition), of these the newest whose
    sizes fit into ``most`` together. ``age`` ascends with age, and is total."""
    return within(rows if since is None else rows.where(since), [], age, size, most)
