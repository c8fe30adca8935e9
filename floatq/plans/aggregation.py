"""Aggregations over expressions; several are one pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floatq.functions import fp

from .expr import Expr, checked


@dataclass(frozen=True)
class Aggregation:
    """kind: sum, min, max, avg, count, or none (the values in the order of row_id, as an array)."""

    kind: str
    expr: Expr
    name: str

    def __post_init__(self) -> None:
        checked(self.expr)
        if self.kind not in ("sum", "min", "max", "avg", "count", "none"):
            raise ValueError(f"unknown aggregation {self.kind}")

    def to_column(self) -> Column:
        v = self.expr.to_column()
        if self.kind == "none":
            pairs = F.array_sort(F.collect_list(F.struct("row_id", v.alias("v"))))
            return F.transform(pairs, lambda p: p["v"]).alias(self.name)
        made = {"sum": fp.sum_, "min": fp.min_, "max": fp.max_, "count": lambda c: F.count(F.lit(1))}.get(self.kind)
        out = made(v) if made else fp.div(fp.sum_(v), F.count(F.lit(1)).cast("double"))
        return out.alias(self.name)


def compute(df: DataFrame, *aggregations: Aggregation, mask: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group of ``by``, with a column for each aggregation, in one pass."""
    if mask is not None:
        df = df.where(mask)
    return (df.groupBy(*by) if by else df).agg(*[a.to_column() for a in aggregations])
