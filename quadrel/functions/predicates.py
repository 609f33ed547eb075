"""Conditions as data, and the one compiler from them to Spark columns (SQL three-valued logic)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from quadrel.schema import Ref, Table


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any = None


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple


@dataclass(frozen=True)
class Exists:
    """Rows of `table` (that fit `where`) whose columns equal the outer ones of `on`."""

    table: Table
    on: tuple[tuple[Ref, Ref], ...]
    where: Any = None
    negated: bool = False


Condition = Compare | Logic | Exists


def eq(a: Any, b: Any) -> Compare:
    return Compare("=", a, b)


def ne(a: Any, b: Any) -> Compare:
    return Compare("!=", a, b)


def gt(a: Any, b: Any) -> Compare:
    return Compare(">", a, b)


def gte(a: Any, b: Any) -> Compare:
    return Compare(">=", a, b)


def lt(a: Any, b: Any) -> Compare:
    return Compare("<", a, b)


def lte(a: Any, b: Any) -> Compare:
    return Compare("<=", a, b)


def like(a: Any, pattern: str) -> Compare:
    """% and _ wildcards, without regard to case."""
    return Compare("like", a, pattern)


ilike = like


def between(a: Any, low: Any, high: Any) -> Compare:
    """Both ends count."""
    return Compare("between", a, (low, high))


def not_between(a: Any, low: Any, high: Any) -> Logic:
    return not_(between(a, low, high))


def regex(a: Any, pattern: str, flags: str = "") -> Compare:
    """Unanchored; flags out of i, s, m, x."""
    if set(flags) - set("ismx"):
        raise ValueError(f"unknown regex flags {flags!r}")
    return Compare("regex", a, (f"(?{flags})" if flags else "") + pattern)


def in_array(a: Any, values: Iterable) -> Compare:
    return Compare("in", a, tuple(values))


def not_in_array(a: Any, values: Iterable) -> Logic:
    return not_(in_array(a, values))


def ends_with(a: Any, text: str) -> Compare:
    return Compare("ends", a, text)


def is_null(a: Any) -> Compare:
    return Compare("null", a)


def is_not_null(a: Any) -> Logic:
    return not_(is_null(a))


def and_(*parts: Condition | None) -> Logic:
    return Logic("and", tuple(p for p in parts if p is not None))


def or_(*parts: Condition | None) -> Logic:
    return Logic("or", tuple(p for p in parts if p is not None))


def not_(part: Condition) -> Logic:
    return Logic("not", (part,))


def exists(table: Table, on: Mapping[Ref, Ref], where: Condition | None = None) -> Exists:
    return Exists(table, tuple(on.items()), where)


def not_exists(table: Table, on: Mapping[Ref, Ref], where: Condition | None = None) -> Exists:
    return Exists(table, tuple(on.items()), where, True)


def from_mapping(table: Table, values: Mapping[str, Any]) -> Logic:
    """{column: value}: null tests for null, a list for membership, else equality; all must hold."""
    one = lambda c, v: is_null(c) if v is None else in_array(c, v) if isinstance(v, list | tuple | set) else eq(c, v)
    return and_(*(one(table.c[k], v) for k, v in values.items()))


def refs(node: Any) -> list[Ref]:
    """The column references in a condition."""
    if isinstance(node, Ref):
        return [node]
    if isinstance(node, Compare):
        return refs(node.left) + refs(node.right)
    if isinstance(node, Logic | tuple):
        return [r for p in (node.parts if isinstance(node, Logic) else node) for r in refs(p)]
    if isinstance(node, Exists):
        return [outer for outer, _ in node.on]
    return []


def split_exists(node: Condition | None) -> tuple[list[Exists], Condition | None]:
    """EXISTS terms that stand under AND alone, which become semi and anti joins, and the rest."""
    if isinstance(node, Exists):
        return [node], None
    if isinstance(node, Logic) and node.op == "and":
        parts = [split_exists(p) for p in node.parts]
        rest = [r for _, r in parts if r is not None]
        return [e for found, _ in parts for e in found], and_(*rest) if rest else None
    if isinstance(node, Logic) and node.op == "not" and isinstance(node.parts[0], Exists):
        e = node.parts[0]
        return [Exists(e.table, e.on, e.where, not e.negated)], None
    return [], node


def to_column(node: Any, resolve: Callable[[Ref], SparkColumn], link_value: Callable[[Ref, Any], Any] = lambda r, v: v) -> SparkColumn:
    """The Spark column of a condition; resolve says where a reference stands."""

    def value(x: Any, of: Any) -> SparkColumn:
        if isinstance(x, Ref):
            return resolve(x)
        if isinstance(x, SparkColumn):
            return x
        return F.lit(link_value(of, x) if isinstance(of, Ref) else x)

    def build(n: Any) -> SparkColumn:
        if isinstance(n, Logic):
            if n.op == "not":
                return ~build(n.parts[0])
            if not n.parts:
                return F.lit(True)
            return reduce((lambda a, b: a & b) if n.op == "and" else (lambda a, b: a | b), map(build, n.parts))
        if isinstance(n, Exists):
            raise ValueError("exists() may stand alone or under and_() and not_(), not under or_()")
        if not isinstance(n, Compare):
            raise TypeError(f"not a condition of this engine: {n!r}")
        a = value(n.left, n.right)
        match n.op:
            case "null":
                return a.isNull()
            case "in":
                return a.isin([link_value(n.left, v) if isinstance(n.left, Ref) else v for v in n.right]) if n.right else F.lit(False)
            case "between":
                return a.between(value(n.right[0], n.left), value(n.right[1], n.left))
            case "like":
                return a.ilike(n.right)
            case "regex":
                return a.rlike(n.right)
            case "ends":
                return F.endswith(a, F.lit(n.right))
        b = value(n.right, n.left)
        return {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[n.op]

    return build(node)
