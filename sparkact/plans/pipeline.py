"""A small declarative pipeline: a source, steps given as data, and an output."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v,
    "contains": lambda c, v: F.contains(c, F.lit(v)), "in": lambda c, v: c.isin(*v), "not_in": lambda c, v: ~c.isin(*v),
}
METRIC = {"count": lambda c: F.count("*"), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def condition(spec: dict[str, Any]) -> Column:
    """{"field", "op", "value"}, or {"all": [...]} and {"any": [...]} of such."""
    if "all" in spec or "any" in spec:
        parts = [condition(x) for x in spec.get("all", spec.get("any"))]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if "all" in spec else out | p
        return out
    if spec["op"] not in COMPARE:
        raise ValueError(f"unknown operator {spec['op']!r}")
    return COMPARE[spec["op"]](F.col(spec["field"]), spec["value"])


@dataclass
class Pipeline:
    """Steps: filter, sort, aggregate, limit, select; each a dictionary with its ``kind``."""

    steps: list[dict[str, Any]] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = getattr(self, f"_{step['kind']}")(df, step)
        return df

    def _filter(self, df, step):
        return df.where(condition(step["where"]))

    def _sort(self, df, step):
        return df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in step["by"]])

    def _aggregate(self, df, step):
        metrics = [METRIC[m["metric"]](F.col(m["field"]) if m.get("field") else None).alias(m["as"]) for m in step["metrics"]]
        return df.groupBy(*step.get("by", [])).agg(*metrics)

    def _limit(self, df, step):
        return df.limit(step["n"])

    def _select(self, df, step):
        return df.select(*step["columns"])
