"""find_many and its kin: rows with their related rows as nested values, in one plan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quadrel.functions.aggregates import Order
from quadrel.functions.predicates import and_, ends_with, eq, in_array, or_
from quadrel.operators.identity import is_absolute
from quadrel.plans.select import Select
from quadrel.schema import Relation, Table

if TYPE_CHECKING:
    from quadrel.database import Database


def link_fields(parent: Table, rel: Relation) -> tuple[list[str], list[str], bool]:
    """Parent columns, child columns, and whether the parent's column is an inverse list of child IRIs."""
    if rel.fields:
        return list(rel.fields), list(rel.references), False
    links = lambda t, other: [n for n, c in t.columns.items() if c.link_to is not None and (c.link_to == other.name or getattr(c.link_to, "name", None) == other.name)]
    for n in links(parent, rel.target):
        if parent.columns[n].is_inverse:
            return [n], ["_iri"], True
    if rel.kind == "many" and (found := links(rel.target, parent)):
        return ["_iri"], found[:1], False
    if rel.kind == "one" and (found := links(parent, rel.target)):
        return found[:1], ["_iri"], False
    if found := links(rel.target, parent):
        return ["_iri"], found[:1], False
    raise ValueError(f"no link between {parent.name} and {rel.target.name}")


def _link_key(t: Table, name: str, c: SparkColumn) -> SparkColumn:
    """A key, or a link below the base of its table, as the short id that it ends in, so that an IRI, a fragment and a bare id meet."""
    column = t.columns.get(name)
    if column is None or column.is_array or column.spark_type.simpleString() != "string" or not (column.primary or column.link_to is not None):
        return c
    base = t.base if column.primary else column.link_to.base if isinstance(column.link_to, Table) else column.link_to if is_absolute(column.link_to) else ""
    below = F.regexp_replace(c, r"^.*[/#]", "")
    return F.when(F.startswith(c, F.lit("#")) | (F.startswith(c, F.lit(base)) if base else F.lit(False)), below).otherwise(c)


def attach(db: Database, df: DataFrame, parent: Table, name: str, rel: Relation, paged: bool = False) -> DataFrame:
    """df (with _iri) and a column `name`: an array of child structs, or for `one` a struct that may be null.

    paged: df is a page, so the child side is first reduced to the rows that the page links to.
    """
    child = db.frame(rel.target)
    own, theirs, inverse = link_fields(parent, rel)
    value = F.struct(*(F.col(f"`{c}`") for c in rel.target.columns))
    links = own != ["_iri"] and theirs != ["_iri"]
    near = lambda c: _link_key(parent, c, F.col(f"`{c}`")) if links else F.col(f"`{c}`")
    far = lambda c: _link_key(rel.target, c, F.col(f"`{c}`")) if links else F.col(f"`{c}`")
    keyed = child.select(*(far(c).alias(f"__k{i}") for i, c in enumerate(theirs)), value.alias("__v")).dropna(subset=[f"__k{i}" for i in range(len(theirs))])
    keys = [f"__k{i}" for i in range(len(theirs))]
    if inverse and parent.columns[own[0]].is_array:
        pairs = df.select(F.col("_iri").alias("__p"), F.explode(F.array_distinct(own[0])).alias("__k0")).join(keyed, "__k0")
        lists = pairs.groupBy("__p").agg(F.array_sort(F.collect_list("__v")).alias(name))
        out = df.join(lists, df["_iri"] == lists["__p"], "left").drop("__p")
        return out.withColumn(name, F.coalesce(name, F.array()))
    made = F.array_sort(F.collect_list("__v")) if rel.kind == "many" else F.min("__v")
    if paged:
        page = df.select(*(near(c).alias(k) for c, k in zip(own, keys, strict=True))).distinct()
        keyed = keyed.join(page, keys, "left_semi")
    lists = keyed.groupBy(*keys).agg(made.alias(name))
    on = reduce(lambda a, b: a & b, (near(c) == F.col(k) for c, k in zip(own, keys, strict=True)))
    out = df.join(lists, on, "left").drop(*keys)
    return out.withColumn(name, F.coalesce(name, F.array())) if rel.kind == "many" else out


class Finder:
    """db.query(table): exact lookups and loads with relations."""

    def __init__(self, db: Database, t: Table) -> None:
        self.db, self.table = db, t

    def find_many(self, where: Any = None, order_by: Any = (), limit: int | None = None, offset: int | None = None, columns: Mapping[str, bool] | list[str] | None = None, with_: Mapping[str, bool] | list[str] = (), subject: Any = None) -> DataFrame:
        """One row for each subject. with_ names relations of the table; they stay beside any `columns`.

        subject, a condition on the id or the IRI, holds before the page is cut.
        """
        t = self.table
        q = Select(self.db, {**{n: t.c[n] for n in t.columns}, "_iri": t.c["_iri"]}).from_(t)
        if where is not None:
            q = q.where(where)
        if subject is not None:
            q = q._where(subject)
        order = (order_by,) if isinstance(order_by, Order | str) or hasattr(order_by, "alias") else tuple(order_by)
        if order:
            q = q.order_by(*order)
        if limit is not None:
            q = q.limit(limit)
        if offset is not None:
            q = q.offset(offset)
        df = q.df()
        wanted = [k for k, v in with_.items() if v] if isinstance(with_, Mapping) else list(with_)
        relations = self.db.relations.get(t.name, {})
        for name in wanted:
            if name not in relations:
                raise ValueError(f"{t.name} has no relation {name!r}")
            rel = relations[name]
            if rel.discover is not None:
                from quadrel.operators.federation import attach_remote

                df = attach_remote(self.db, df, t, name, rel)
            else:
                df = attach(self.db, df, t, name, rel, limit is not None or subject is not None)
        kept = list(t.columns) if columns is None else [k for k, v in columns.items() if v] if isinstance(columns, Mapping) else list(columns)
        if order and wanted:  # the joins may have dealt the page out anew
            place = lambda o: o.by if isinstance(o.by, str) else o.by.name
            df = df.orderBy(*(o.to_column(F.col(f"`{place(o)}`")) for o in (x if isinstance(x, Order) else Order(x) for x in order)))
        return df.select(*(F.col(f"`{c}`") for c in kept), *wanted)

    def find_first(self, **options: Any) -> Row | None:
        return self.find_many(**options | {"limit": 1}).first()

    def count(self, where: Any = None) -> int:
        q = Select(self.db, {"n": _count()}).from_(self.table)
        return (q.where(where) if where is not None else q).df().first()["n"]

    def find_by_iri(self, iri: str, **options: Any) -> DataFrame:
        return self.find_many(**options, subject=eq(self.table.c["_iri"], iri))

    def find_by_iris(self, iris: list[str], **options: Any) -> DataFrame:
        """The rows of several subjects; those that do not exist are left out."""
        return self.find_many(**options, subject=in_array(self.table.c["_iri"], iris))

    def merged(self) -> DataFrame:
        """One row for each subject where the frame holds several: lists are united, of other values the smallest counts."""
        df, t = self.db.frame(self.table), self.table
        one = lambda n, c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col(f"`{n}`"))))) if c.is_array else F.min(F.col(f"`{n}`"))
        return df.groupBy("_iri").agg(*(one(n, c).alias(n) for n, c in t.columns.items())).select(*(F.col(f"`{n}`") for n in t.columns), "_iri")

    def find_by_id(self, value: Any, **options: Any) -> DataFrame:
        return self.find_many(**options, subject=eq(self.table.c[self.table.pk], value))

    def find_by_resource(self, ref: str, **options: Any) -> DataFrame:
        """By absolute IRI, by path below the base, or by a short id that ends exactly one subject."""
        from quadrel.operators.identity import is_absolute

        if is_absolute(ref):
            return self.find_by_iri(ref, **options)
        iri = self.table.c["_iri"]
        short = or_(ends_with(iri, "#" + ref), ends_with(iri, "/" + ref), eq(iri, self.table.base + ref))
        if Select(self.db, {"iri": iri}).from_(self.table)._where(short).distinct().limit(2).df().count() > 1:
            raise ValueError(f"{ref!r} stands for more than one row of {self.table.name}")
        return self.find_many(**options, subject=short)

    def find_by_locator(self, locator: Mapping[str, Any], **options: Any) -> DataFrame:
        """By the values of the template's variables; date parts may be left out."""
        from quadrel.operators.identity import DATE_PARTS, names

        missing = [n for n in names(self.table.template) if n not in locator and n not in DATE_PARTS and n != "index"]
        if missing:
            raise ValueError(f"locator of {self.table.name} lacks {', '.join(missing)}")
        own = lambda n: self.table.pk if n == "id" and "id" not in self.table.columns else n
        return self.find_many(**options, subject=and_(*(eq(self.table.c[own(n)], v) for n, v in locator.items())))


def _count() -> Any:
    from quadrel.functions.aggregates import count

    return count()
