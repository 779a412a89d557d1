"""Rule engines as expressions: ordered first-hit rules and additive scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_hit(rules: list[tuple[str, Column]], default: str) -> Column:
    """The label of the first rule that holds; the order is part of the meaning."""
    out = F
    for label, holds in rules:
        out = out.when(holds, label)
    return out.otherwise(default) if rules else F.lit(default)


def scored(rules: list[tuple[str, int, Column]], thresholds: dict[str, int], default: str, gap: int = 0, guarded: tuple[str, ...] = ()) -> Column:
    """struct<label, confidence>: the label with most points if it reaches its threshold and, for
    guarded labels, leads by ``gap``; ties go to the smaller label; confidence is 55 to 98."""
    labels = sorted({label for label, _, _ in rules})
    totals = []
    for label in labels:
        points = F.lit(0)
        for name, value, holds in rules:
            if name == label:
                points = points + F.when(holds, value).otherwise(0)
        totals.append(F.struct((-points).alias("minus"), F.lit(label).alias("label")))
    best = F.array_sort(F.array(*totals))
    top, second = best[0], F.get(best, F.lit(1))
    need = F.coalesce(F.element_at(F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))]), top["label"]), F.lit(1)) if thresholds else F.lit(1)
    lead = F.coalesce(second["minus"], F.lit(0)) - top["minus"]
    fits = (-top["minus"] >= need) & (~top["label"].isin(*guarded) | (lead >= gap)) if guarded else -top["minus"] >= need
    label = F.when(fits, top["label"]).otherwise(default)
    return F.struct(label.alias("label"), F.when(fits, F.least(F.greatest(-top["minus"], F.lit(55)), F.lit(98))).otherwise(0).alias("confidence"))


def resolved(*stages: Column) -> Column:
    """User rule, learned label, built-in rule, ... : the first that isn't null."""
    return F.coalesce(*stages)
