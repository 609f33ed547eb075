"""The select builder: collects a plan, then compiles it to one lazy DataFrame.

Each table comes in with its columns named alias__column, so self joins stay apart; Catalyst prunes what
nothing reads. Order of work: joins, filters, groups, having, order, distinct, page, projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.aggregates import Aggregate, Order, asc, desc
from quadrel.functions.predicates import Compare, Exists, Logic, and_, from_mapping, refs, split_exists, to_column
from quadrel.operators.identity import link_value
from quadrel.schema import Ref, Table

if TYPE_CHECKING:
    from quadrel.database import Database

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross"}


@dataclass(frozen=True)
class Join:
    how: str
    table: Table
    on: tuple[tuple[Ref, Ref], ...] = ()


@dataclass(frozen=True)
class SelectPlan:
    """What a select means, independent of Spark."""

    base: Table | None = None
    projection: Mapping[str, Any] | None = None
    joins: tuple[Join, ...] = ()
    where: Any = None
    group_by: tuple[Ref, ...] = ()
    having: Any = None
    order_by: tuple[Order, ...] = ()
    distinct: bool = False
    limit: int | None = None
    offset: int | None = None
    graphs: tuple[str, ...] = field(default=())


def _whole(n: Any, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"{what} must be a whole number from 0 on, not {n!r}")
    return n


def equalities(on: Any) -> tuple[tuple[Ref, Ref], ...]:
    """The column pairs of a join condition: {a: b}, a = b, or AND of such."""
    if isinstance(on, Mapping):
        pairs = tuple(on.items())
    elif isinstance(on, Compare) and on.op == "=":
        pairs = ((on.left, on.right),)
    elif isinstance(on, Logic) and on.op == "and" and on.parts:
        pairs = tuple(p for part in on.parts for p in equalities(part))
    else:
        raise ValueError("a join condition is an equality of columns, or AND of such")
    if not pairs or not all(isinstance(x, Ref) for p in pairs for x in p):
        raise ValueError("a join condition compares columns of both sides")
    return pairs


class Select:
    """db.select(...).from_(t).where(...)...; df() compiles, plan() shows."""

    def __init__(self, db: Database, fields: Mapping[str, Any] | None = None) -> None:
        self._db, self._plan = db, SelectPlan(projection=dict(fields) if fields is not None else None)

    def _with(self, **more: Any) -> Select:
        new = Select(self._db)
        new._plan = replace(self._plan, **more)
        return new

    def from_(self, t: Table) -> Select:
        return self._with(base=t)

    def columns(self, **fields: Any) -> Select:
        return self._with(projection=fields)

    def where(self, condition: Any) -> Select:
        """Several calls must all hold. {column: value} is allowed; the id is not: use find_by_id and the like."""
        if isinstance(condition, Mapping):
            condition = from_mapping(self._plan.base, condition)
        for r in refs(condition):
            if r.name == "_iri" or (r.column is not None and r.column.primary and r.column.kind == "id"):
                raise ValueError("where() does not take the id; use find_by_id(), find_by_iri() or where_cursor()")
        return self._where(condition)

    def _where(self, condition: Any) -> Select:
        return self._with(where=condition if self._plan.where is None else and_(self._plan.where, condition))

    def where_cursor(self, condition: Any) -> Select:
        """Keyset paging: a sort predicate together with a range on the id."""
        found = [c for c in _leaves(condition) if isinstance(c, Compare)]
        is_id = lambda c: isinstance(c.left, Ref) and (c.left.name == "_iri" or (c.left.column is not None and c.left.column.primary))
        if not any(is_id(c) and c.op in ("<", "<=", ">", ">=") for c in found) or all(map(is_id, found)):
            raise ValueError("where_cursor() takes a sort predicate and a range on the id")
        return self._where(condition)

    def _join(self, how: str, t: Table, on: Any = None) -> Select:
        taken = {self._plan.base.alias_name, *(j.table.alias_name for j in self._plan.joins)}
        if t.alias_name in taken:
            raise ValueError(f"{t.alias_name} is joined already; give it another name with alias()")
        return self._with(joins=(*self._plan.joins, Join(how, t, equalities(on) if how != "cross" else ())))

    def inner_join(self, t: Table, on: Any) -> Select:
        return self._join("inner", t, on)

    def left_join(self, t: Table, on: Any) -> Select:
        return self._join("left", t, on)

    def right_join(self, t: Table, on: Any) -> Select:
        """Beyond parity."""
        return self._join("right", t, on)

    def full_join(self, t: Table, on: Any) -> Select:
        """Beyond parity."""
        return self._join("full", t, on)

    def cross_join(self, t: Table) -> Select:
        return self._join("cross", t)

    def group_by(self, *columns: Ref | str) -> Select:
        return self._with(group_by=(*self._plan.group_by, *(self._ref(c) for c in columns)))

    def having(self, condition: Any | Callable[[Any], Any]) -> Select:
        """A condition on output names: Ref(None, name), or a function of an object that has them as attributes."""
        return self._with(having=condition(_Outputs()) if callable(condition) else condition)

    def order_by(self, *by: Ref | str | Order, direction: str = "asc") -> Select:
        made = tuple(b if isinstance(b, Order) else (desc(b) if direction == "desc" else asc(b)) for b in by)
        return self._with(order_by=(*self._plan.order_by, *made))

    def limit(self, n: int) -> Select:
        return self._with(limit=_whole(n, "limit"))

    def offset(self, n: int) -> Select:
        return self._with(offset=_whole(n, "offset"))

    def distinct(self) -> Select:
        return self._with(distinct=True)

    def plan(self) -> SelectPlan:
        return self._plan

    def df(self) -> DataFrame:
        return compile_select(self._db, self._plan)

    def to_sql(self) -> str:
        """The optimised plan as text."""
        return self.df()._jdf.queryExecution().optimizedPlan().toString()

    def to_sparql(self) -> str:
        from quadrel.sparql.emit import select_text

        return select_text(self._plan)

    def union(self, other: Select) -> DataFrame:
        """Beyond parity, as are union_all, intersect and except_."""
        return self.df().unionByName(other.df()).distinct()

    def union_all(self, other: Select) -> DataFrame:
        return self.df().unionByName(other.df())

    def intersect(self, other: Select) -> DataFrame:
        return self.df().intersect(other.df())

    def except_(self, other: Select) -> DataFrame:
        return self.df().subtract(other.df())

    def _ref(self, c: Ref | str) -> Ref:
        return c if isinstance(c, Ref) else _named(self._plan, c)


class _Outputs:
    def __getattr__(self, name: str) -> Ref:
        return Ref(None, name)


def _leaves(node: Any) -> list[Any]:
    return [x for p in node.parts for x in _leaves(p)] if isinstance(node, Logic) else [node]


def _named(plan: SelectPlan, name: str) -> Ref:
    """'column' of the base, or 'Alias.column'."""
    tables = {t.alias_name: t for t in (plan.base, *(j.table for j in plan.joins))}
    head, dot, tail = name.partition(".")
    if dot and head in tables:
        return tables[head].c[tail]
    if name in plan.base.columns:
        return plan.base.c[name]
    raise ValueError(f"no column {name!r}")


def _is_field(x: Any) -> bool:
    return isinstance(x, Ref | str | Aggregate | SparkColumn)


def _has_aggregate(fields: Mapping[str, Any] | None) -> bool:
    return any(isinstance(f, Aggregate) for f in (fields or {}).values())


def compile_select(db: Database, plan: SelectPlan) -> DataFrame:
    base = plan.base
    if base is None:
        raise ValueError("a select needs from_()")
    joined = {j.table.alias_name for j in plan.joins}
    at = lambda r: F.col(f"`{r.alias}__{r.name}`")
    df = db.frame(base, prefix=True)
    for j in plan.joins:
        right = db.frame(j.table, prefix=True)
        if j.how == "cross":
            df = df.crossJoin(right)
            continue
        known = set(df.columns) | set(right.columns)
        for pair in j.on:
            for r in pair:
                if f"{r.alias}__{r.name}" not in known:
                    raise ValueError(f"{r.alias}.{r.name} stands on neither side of the join")
        df = df.join(right, reduce(lambda a, b: a & b, (at(a) == at(b) for a, b in j.on)), JOINS[j.how])
    value = lambda r, v: link_value(r.column.link_to, v) if r.column is not None and r.column.link_to is not None else v
    tests, rest = split_exists(plan.where)
    if rest is not None:
        df = df.filter(to_column(rest, at, value))
    for e in tests:
        df = _exists(db, df, e, at, value)

    fields = plan.projection
    if plan.group_by or _has_aggregate(fields):
        df, outputs = _grouped(plan, df, at)
        if plan.having is not None:
            df = df.filter(to_column(plan.having, lambda r: F.col(f"`{r.name}`") if r.alias is None else outputs(r)))
        hidden = [c for c in df.columns if c.startswith("_g__")]
        if plan.distinct:  # over what is put out: a group key that nothing shows must not tell rows apart
            df = df.drop(*hidden).distinct()
            shown = {f"{r.alias}__{r.name}": n for n, f in (fields or {r.name: r for r in plan.group_by}).items() if isinstance(r := _named(plan, f) if isinstance(f, str) else f, Ref)}
            return _page(_sorted(df, plan, shown), plan)
        sort = [o.to_column(F.col(f"`{o.by}`") if isinstance(o.by, str) and o.by in df.columns else outputs(o.by if isinstance(o.by, Ref) else _named(plan, o.by))) for o in plan.order_by]
        return _page(df.orderBy(*sort) if sort else df, plan).drop(*hidden)
    if plan.having is not None:
        raise ValueError("having() needs group_by() or aggregates")

    if fields is None:
        out = [F.col(f"`{c}`").alias(c.removeprefix(base.alias_name + "__")) for c in df.columns if not c.endswith("___iri")]
        names = {f"{base.alias_name}__{n}": n for n in base.columns}
    else:
        out = [_project(db, plan, f, joined).alias(n) for n, f in fields.items()]
        names = {f"{r.alias}__{r.name}": n for n, f in fields.items() if isinstance(r := _named(plan, f) if isinstance(f, str) else f, Ref)}
    if plan.distinct:  # before the page; sorting is by what is put out
        return _page(_sorted(df.select(*out).distinct(), plan, names), plan)
    if plan.order_by:

        def place(o: Order) -> SparkColumn:
            if isinstance(o.by, Ref):
                return at(o.by)
            if fields is not None and o.by in fields and isinstance(fields[o.by], Ref | SparkColumn):
                return at(fields[o.by]) if isinstance(fields[o.by], Ref) else fields[o.by]
            return at(_named(plan, o.by))

        df = df.orderBy(*(o.to_column(place(o)) for o in plan.order_by))
    return _page(df, plan).select(*out)


def _sorted(df: DataFrame, plan: SelectPlan, shown: Mapping[str, str]) -> DataFrame:
    """df in the plan's order, by what it puts out. shown: output name by alias__column."""

    def stands(o: Order) -> SparkColumn:
        if isinstance(o.by, str) and o.by in df.columns:
            return F.col(f"`{o.by}`")
        r = o.by if isinstance(o.by, Ref) else _named(plan, o.by)
        if (name := shown.get(f"{r.alias}__{r.name}")) is None:
            raise ValueError("distinct() sorts by selected columns only")
        return F.col(f"`{name}`")

    return df.orderBy(*(o.to_column(stands(o)) for o in plan.order_by)) if plan.order_by else df


def _page(df: DataFrame, plan: SelectPlan) -> DataFrame:
    if plan.offset:
        df = df.offset(plan.offset)
    return df.limit(plan.limit) if plan.limit is not None else df


def _exists(db: Database, df: DataFrame, e: Exists, at: Callable, value: Callable) -> DataFrame:
    inner = db.frame(e.table, prefix=True)
    if e.where is not None:
        inner = inner.filter(to_column(e.where, at, value))
    keys = [F.col(f"`{b.alias}__{b.name}`").alias(f"_e{k}") for k, (_, b) in enumerate(e.on)]
    on = reduce(lambda a, b: a & b, (at(a) == F.col(f"_e{k}") for k, (a, _) in enumerate(e.on)))
    return df.join(inner.select(*keys), on, "left_anti" if e.negated else "left_semi")


def _grouped(plan: SelectPlan, df: DataFrame, at: Callable) -> tuple[DataFrame, Callable[[Ref], SparkColumn]]:
    fields = dict(plan.projection or {r.name: r for r in plan.group_by})
    grouped = {(r.alias, r.name) for r in plan.group_by}
    plain = {n: (f if isinstance(f, Ref) else _named(plan, f)) for n, f in fields.items() if not isinstance(f, Aggregate)}
    if plain and not plan.group_by:
        raise ValueError("aggregates next to plain columns need group_by()")
    for n, r in plain.items():
        if (r.alias, r.name) not in grouped:
            raise ValueError(f"{n} is neither grouped nor an aggregate")
    keys = [at(r).alias(f"_g__{r.alias}__{r.name}") for r in plan.group_by]
    key_of = lambda r: F.col(f"`_g__{r.alias}__{r.name}`")
    # a row's own columns: the IRI follows from them
    whole = [F.col(f"`{c}`") for c in df.columns if not c.endswith("___iri")]
    made = [f.to_column(at, whole).alias(n) for n, f in fields.items() if isinstance(f, Aggregate)]
    out = df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()
    order = [(F.col(f"`{n}`") if isinstance(f, Aggregate) else key_of(plain[n]).alias(n)) for n, f in fields.items()]
    return out.select(*order, *(key_of(r) for r in plan.group_by)), key_of


def _project(db: Database, plan: SelectPlan, f: Any, joined: set[str]) -> SparkColumn:
    at = lambda r: F.col(f"`{r.alias}__{r.name}`")
    if isinstance(f, str):
        f = _named(plan, f)
    if isinstance(f, Ref):
        return at(f)
    if isinstance(f, SparkColumn):
        return f
    if isinstance(f, Table):  # the whole row as a struct
        f = {n: f.c[n] for n in f.columns}
    if isinstance(f, Mapping):
        flat = _flat(plan, f)
        made = F.struct(*(_project(db, plan, v, joined).alias(k) for k, v in f.items()))
        # nothing but joined columns and all of them empty: there was no match
        if flat and all(r.alias in joined for r in flat):
            return F.when(F.coalesce(*(at(r).cast("string") for r in flat)).isNotNull(), made)
        return made
    raise TypeError(f"cannot select {f!r}")


def _flat(plan: SelectPlan, f: Any) -> list[Ref]:
    if isinstance(f, str):
        return [_named(plan, f)]
    if isinstance(f, Table):
        return [f.c[n] for n in f.columns]
    return [r for v in f.values() for r in _flat(plan, v)] if isinstance(f, Mapping) else [f] if isinstance(f, Ref) else []
