"""Aggregates and orderings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from quadrel.schema import Ref


@dataclass(frozen=True)
class Aggregate:
    """fn over a column; column None is the row itself (count only)."""

    fn: str
    column: Ref | None = None
    distinct: bool = False

    def __post_init__(self) -> None:
        if self.column is None and self.fn != "count":
            raise ValueError(f"{self.fn}() needs a column")

    def to_column(self, resolve: Callable[[Ref], SparkColumn], whole: list[SparkColumn]) -> SparkColumn:
        if self.column is None:
            return F.count_distinct(F.struct(*whole)) if self.distinct else F.count("*")
        c = resolve(self.column)
        if self.column.column is not None and self.column.column.is_array and self.fn == "count" and not self.distinct:
            return F.count(F.when(F.size(c) > 0, 1))  # rows that have any value
        if not self.distinct or self.fn in ("min", "max"):
            return getattr(F, self.fn)(c)
        return {"count": F.count_distinct, "sum": F.sum_distinct, "avg": _avg_distinct}[self.fn](c)


def _avg_distinct(c: SparkColumn) -> SparkColumn:
    return F.sum_distinct(c.cast("double")) / F.count_distinct(c)


def count(column: Ref | None = None, distinct: bool = False) -> Aggregate:
    return Aggregate("count", column, distinct)


def sum_(column: Ref | None = None, distinct: bool = False) -> Aggregate:
    return Aggregate("sum", column, distinct)


def avg(column: Ref | None = None, distinct: bool = False) -> Aggregate:
    return Aggregate("avg", column, distinct)


def min_(column: Ref | None = None, distinct: bool = False) -> Aggregate:
    return Aggregate("min", column, distinct)


def max_(column: Ref | None = None, distinct: bool = False) -> Aggregate:
    return Aggregate("max", column, distinct)


@dataclass(frozen=True)
class Order:
    """Nulls stand last going up and first going down."""

    by: Ref | str
    descending: bool = False

    def to_column(self, c: SparkColumn) -> SparkColumn:
        return c.desc_nulls_first() if self.descending else c.asc_nulls_last()


def asc(by: Ref | str) -> Order:
    return Order(by)


def desc(by: Ref | str) -> Order:
    return Order(by, True)
