"""Privacy rules as column expressions: what is skipped, what is recorded without its details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkact.functions import apps
from sparkact.functions import text as tx
from sparkact.functions.names import fresh


def ignored(app: Column, rules: list[str]) -> Column:
    """Whether the name that a program is displayed by contains one of the rules, in any case."""
    shown = F.lower(apps.display_name(app))
    return F.exists(F.array(*[F.lit(r.lower()) for r in rules]), lambda r: F.contains(shown, r)) if rules else F.lit(False)


def excluded(url: Column, domains: list[str]) -> Column:
    """Whether a url's host is one of the domains or lies under one."""
    return F.coalesce(F.arrays_overlap(tx.suffixes(tx.host(url)), F.array(*map(F.lit, domains))), F.lit(False)) if domains else F.lit(False)


def action(app: Column, title: Column, url: Column, app_rules: list[tuple[str, str]], keywords: list[str], domains: list[str]) -> Column:
    """skip, anonymize or record: the first app rule that fits, then title words, then domains."""
    out = F
    for name, what in app_rules:
        out = out.when(F.contains(F.lower(app), F.lit(name.lower())), what)
    for word in keywords:
        out = out.when(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(word.lower())), "anonymize")
    return out.when(excluded(url, domains), "skip").otherwise("record")


def applied(df: DataFrame, what: Column, hidden: list[str], placeholder: dict[str, str] | None = None) -> DataFrame:
    """Rows that aren't skipped; of anonymized ones the ``hidden`` columns are null or a placeholder."""
    placeholder = placeholder or {}
    act = fresh("_action", df)
    kept = df.withColumn(act, what).where(F.col(act) != "skip")
    return kept.withColumns({c: F.when(F.col(act) == "anonymize", F.lit(placeholder.get(c)).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in hidden}).drop(act)


def shown_to_others(df: DataFrame, dropped: list[str], title: str, n: int = 40) -> DataFrame:
    """The view for callers from outside: some columns gone, titles cut."""
    return df.drop(*dropped).withColumn(title, tx.excerpt(F.col(title), n))
