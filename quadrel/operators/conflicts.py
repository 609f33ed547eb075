"""Merging two versions of a table, row by row or field by field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(local: DataFrame, remote: DataFrame, key: str) -> tuple[DataFrame, list[str], SparkColumn, SparkColumn]:
    columns = [c for c in local.columns if c != key]
    side = lambda df, name: df.select(F.col(f"`{key}`"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias(name))
    return side(local, "l").join(side(remote, "r"), key, "full"), columns, F.col("l"), F.col("r")


def _rows(df: DataFrame, key: str, columns: list[str], chosen: SparkColumn) -> DataFrame:
    return df.select(F.col(f"`{key}`"), chosen.alias("v")).select(F.col(f"`{key}`"), *(F.col(f"v.`{c}`") for c in columns))


def last_write_wins(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """The local row, the later write, wherever there is one."""
    df, columns, l, r = _both(local, remote, key)  # noqa: E741
    return _rows(df, key, columns, F.coalesce(l, r))


def by_timestamp(local: DataFrame, remote: DataFrame, key: str, at: str) -> DataFrame:
    """The row with the later `at`; the remote one on a tie or where the local has none."""
    df, columns, l, r = _both(local, remote, key)  # noqa: E741
    later = F.coalesce(l[at] > r[at], r[at].isNull() & l[at].isNotNull())
    return _rows(df, key, columns, F.when(r.isNull() | (l.isNotNull() & later), l).otherwise(r))


def by_field(base: DataFrame, local: DataFrame, remote: DataFrame, key: str, prefer: str = "remote") -> DataFrame:
    """Three-way: each field takes the side that changed it; where both did, `prefer`. Rows either side dropped go."""
    df, columns, l, r = _both(local, remote, key)  # noqa: E741
    old = base.select(F.col(f"`{key}`"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("b"))
    df = df.join(old, key, "left")
    b = F.col("b")
    mine, theirs = (l, r) if prefer == "local" else (r, l)
    merged = F.struct(*(F.when(mine[c].eqNullSafe(b[c]), theirs[c]).otherwise(mine[c]).alias(c) for c in columns))
    gone = b.isNotNull() & (l.isNull() | r.isNull())
    return _rows(df.filter(~gone), key, columns, F.when(l.isNull(), r).when(r.isNull(), l).otherwise(merged))


def by_user(local: DataFrame, remote: DataFrame, key: str, resolver: Callable[[str, SparkColumn, SparkColumn], SparkColumn]) -> DataFrame:
    """resolver(column name, local value, remote value) makes the value where both sides have the row."""
    df, columns, l, r = _both(local, remote, key)  # noqa: E741
    merged = F.struct(*(resolver(c, l[c], r[c]).alias(c) for c in columns))
    return _rows(df, key, columns, F.when(l.isNull(), r).when(r.isNull(), l).otherwise(merged))


def conflicts(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """key, field, local and remote (as text) wherever both sides have the row and differ."""
    df, columns, l, r = _both(local, remote, key)  # noqa: E741
    each = F.array(*(F.struct(F.lit(c).alias("field"), l[c].cast("string").alias("local"), r[c].cast("string").alias("remote"), (~l[c].eqNullSafe(r[c])).alias("differ")) for c in columns))
    return df.filter(l.isNotNull() & r.isNotNull()).select(F.col(f"`{key}`"), F.inline(F.filter(each, lambda x: x["differ"]))).drop("differ")
