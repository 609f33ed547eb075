"""Insert, update, delete and upsert: each makes the table's next version, as one lazy rewrite."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.predicates import from_mapping, refs, to_column
from quadrel.operators.identity import link_value
from quadrel.operators.keys import generated, with_keys
from quadrel.schema import Ref, Table

if TYPE_CHECKING:
    from quadrel.database import Database


@dataclass(frozen=True)
class ChangePlan:
    """What a change means, independent of Spark. rows is None for an insert from a DataFrame."""

    kind: str
    table: Table
    rows: tuple[Mapping[str, Any], ...] | None = None
    values: Mapping[str, Any] | None = None
    where: Any = None


def with_defaults(t: Table, df: DataFrame) -> DataFrame:
    """All columns of t in order: given values, else defaults, else null; the key last, so that it can use the others.

    A text key that no row has, or that some rows lack, is generated (see keys.with_keys).
    """
    if generated(t) and (t.pk not in df.columns or not df.filter(F.col(f"`{t.pk}`").isNull()).isEmpty()):
        others = _with_defaults(t, df.withColumn(t.pk, F.col(f"`{t.pk}`") if t.pk in df.columns else F.lit(None).cast("string")))
        return with_keys(t, others)
    return _with_defaults(t, df)


def _with_defaults(t: Table, df: DataFrame) -> DataFrame:
    order = [n for n, c in t.columns.items() if not c.primary] + [t.pk]
    given, links = set(df.columns), {}
    for n in order:
        c = t.columns[n]
        default = c.default_value() if callable(c.default_value) else c.default_value
        default = None if c.primary and isinstance(default, str) else default  # a template
        value = F.col(f"`{n}`") if n in given else F.lit(None)
        if default is not None:
            value = F.coalesce(value, default if hasattr(default, "_jc") else F.lit(default))
        if c.link_to is not None and not c.is_array and isinstance(prefix := link_value(c.link_to, "\0"), str):
            head, _, tail = prefix.partition("\0")
            value = F.when(value.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), value).otherwise(F.concat(F.lit(head), value.cast("string"), F.lit(tail))) if head or tail else value
        links[n] = value
        df = df.withColumn(n, value.cast(c.spark_type))
    return df.select(*(F.col(f"`{n}`") for n in t.columns))


def check_keys(t: Table, new: DataFrame, old: DataFrame | None) -> None:
    """Raises on a repeated key within the batch, a key that is stored already, or an empty required value. One job."""
    pk = F.col(f"`{t.pk}`").alias("key")
    needed = [n for n, c in t.columns.items() if c.required]
    lacks = [F.max(F.col(f"`{n}`").isNull()).alias(f"lacks_{k}") for k, n in enumerate(needed)]
    keys = new.groupBy(pk).agg(F.count("*").alias("n"), *lacks).withColumn("stored", F.lit(False))
    if old is not None:
        keys = keys.drop("stored").join(old.select(pk).distinct().withColumn("stored", F.lit(True)), "key", "left")
    wrong = keys.filter(" or ".join(["n > 1", "stored", *(f"lacks_{k}" for k in range(len(needed)))])).first()
    if wrong is None:
        return
    for k, n in enumerate(needed):
        if wrong[f"lacks_{k}"]:
            raise ValueError(f"{t.name}: {n} must have a value")
    if wrong["n"] > 1:
        raise ValueError(f"{t.name}: key {wrong['key']!r} stands twice in the batch")
    raise ValueError(f"Duplicate primary key {wrong['key']!r} in {t.name}")


class _Change:
    def __init__(self, db: Database, t: Table) -> None:
        self.db, self.table, self.condition = db, t, None

    def where(self, condition: Any) -> Any:
        self.condition = from_mapping(self.table, condition) if isinstance(condition, Mapping) else condition
        return self

    def _test(self) -> Any:
        if self.condition is None:
            raise ValueError(f"{type(self).__name__.lower()} needs where()")
        if any(r.alias != self.table.alias_name for r in refs(self.condition)):
            raise ValueError("a change is decided by the table's own columns")
        value = lambda r, v: link_value(r.column.link_to, v) if isinstance(r, Ref) and r.column is not None and r.column.link_to is not None else v
        return F.coalesce(to_column(self.condition, lambda r: F.col(f"`{r.name}`"), value), F.lit(False))

    def _rows(self, df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
        return df.select(*(F.col(f"`{c}`") for c in fields or self.table.columns))

    def _put(self, df: DataFrame) -> None:
        self.db.put(self.table, df)

    def to_sparql(self) -> str:
        from quadrel.sparql.emit import change_text

        return change_text(self.plan())

    def _hook(self, name: str, rows: DataFrame) -> None:
        if (f := self.table.hooks.get(name)) is not None:
            try:
                f(rows)
            except Exception as error:  # a hook does not undo the change
                self.db.spark.sparkContext._jvm.org.slf4j.LoggerFactory.getLogger("quadrel").warn(f"{name} of {self.table.name}: {error}")


class Insert(_Change):
    """insert(t).values(rows or DataFrame).returning(...)"""

    def values(self, rows: DataFrame | Mapping[str, Any] | list[Mapping[str, Any]]) -> Insert:
        if not isinstance(rows, DataFrame):
            rows = [rows] if isinstance(rows, Mapping) else list(rows)
            self.given = tuple(dict(r) for r in rows)
            used = [n for n in self.table.columns if any(n in r for r in rows)]
            if unknown := {k for r in rows for k in r} - set(self.table.columns):
                raise ValueError(f"{self.table.name} has no column {sorted(unknown)[0]!r}")
            from pyspark.sql import types as T

            kinds = T.StructType([T.StructField(n, self.table.columns[n].spark_type) for n in used])
            rows = self.db.spark.createDataFrame([tuple(r.get(n) for n in used) for r in rows], kinds)
        self.new = with_defaults(self.table, rows)
        return self

    def plan(self) -> ChangePlan:
        return ChangePlan("insert", self.table, getattr(self, "given", None))

    def run(self) -> DataFrame:
        old = self.db.frames.get(self.table.name)
        check_keys(self.table, self.new, old)
        self.db.put(self.table, self.new if old is None else old.unionByName(self.new), self.new)
        self._hook("after_insert", self.new)
        return self.new

    def returning(self, *fields: str) -> DataFrame:
        return self._rows(self.run(), fields)


class Update(_Change):
    """update(t).set({...}).where(...).returning(...). None clears a value, a list replaces all values."""

    def set(self, values: Mapping[str, Any]) -> Update:
        if unknown := set(values) - set(self.table.columns):
            raise ValueError(f"{self.table.name} has no column {sorted(unknown)[0]!r}")
        if self.table.pk in values:
            raise ValueError("the key does not change")
        self.new = dict(values)
        return self

    def plan(self) -> ChangePlan:
        return ChangePlan("update", self.table, values=self.new, where=self.condition)

    def _changed(self, n: str) -> Any:
        c, v = self.table.columns[n], self.new[n]
        if hasattr(v, "_jc"):
            return v.cast(c.spark_type)
        if c.link_to is not None:
            v = link_value(c.link_to, v)
        return F.array(*map(F.lit, v)).cast(c.spark_type) if isinstance(v, list | tuple) else F.lit(v).cast(c.spark_type)

    def run(self) -> DataFrame:
        old, test = self.db.frames[self.table.name], self._test()
        if cleared := [n for n, v in self.new.items() if v is None and self.table.columns[n].required]:
            raise ValueError(f"{self.table.name}: {cleared[0]} must have a value")
        self._put(old.withColumns({n: F.when(test, self._changed(n)).otherwise(F.col(f"`{n}`")) for n in self.new}))
        rows = old.filter(test).withColumns({n: self._changed(n) for n in self.new})
        self._hook("after_update", rows)
        return rows

    def returning(self, *fields: str) -> DataFrame:
        return self._rows(self.run(), fields)


class Delete(_Change):
    """delete(t).where(...).returning(...): the rows as they were."""

    def plan(self) -> ChangePlan:
        return ChangePlan("delete", self.table, where=self.condition)

    def run(self) -> DataFrame:
        old, test = self.db.frames[self.table.name], self._test()
        self._put(old.filter(~test))
        rows = old.filter(test)
        self._hook("after_delete", rows)
        return rows

    def returning(self, *fields: str) -> DataFrame:
        return self._rows(self.run(), fields)


def upsert(db: Database, t: Table, df: DataFrame) -> DataFrame:
    """Rows of df take the place of stored ones with their key; the others are added. Returns the new version."""
    new, old = with_defaults(t, df), db.frames[t.name]
    check_keys(t, new, None)
    db.put(t, old.join(new.select(t.pk), t.pk, "left_anti").select(*old.columns).unionByName(new))
    return db.frames[t.name]


def insert_once(db: Database, t: Table, df: DataFrame) -> DataFrame:
    """Adds the rows of df whose keys are not stored yet; returns those."""
    new, old = with_defaults(t, df), db.frames[t.name]
    check_keys(t, new, None)
    fresh = new.join(old.select(t.pk), t.pk, "left_anti").select(*old.columns)
    db.put(t, old.unionByName(fresh), fresh)
    return fresh


def update_by_id(db: Database, t: Table, value: Any, values: Mapping[str, Any]) -> DataFrame:
    return Update(db, t).set({k: v for k, v in values.items() if k != t.pk}).where({t.pk: value}).returning()


def delete_by_id(db: Database, t: Table, value: Any) -> DataFrame:
    return Delete(db, t).where({t.pk: value}).returning()


def update_by_iri(db: Database, t: Table, iri: str, values: Mapping[str, Any]) -> DataFrame:
    return update_by_id(db, t, _key_of(db, t, iri), values)


def delete_by_iri(db: Database, t: Table, iri: str) -> DataFrame:
    return delete_by_id(db, t, _key_of(db, t, iri))


def update_by_resource(db: Database, t: Table, ref: str, values: Mapping[str, Any]) -> DataFrame:
    """ref as for find_by_resource: an IRI, a path below the base, or a short id that ends exactly one subject."""
    return update_by_id(db, t, _key_at(db, t, ref), values)


def delete_by_resource(db: Database, t: Table, ref: str) -> DataFrame:
    return delete_by_id(db, t, _key_at(db, t, ref))


def _key_at(db: Database, t: Table, ref: str) -> Any:
    row = db.query(t).find_by_resource(ref).select(t.pk).first()
    return None if row is None else row[0]


def _key_of(db: Database, t: Table, iri: str) -> Any:
    row = db.frame(t).filter(F.col("_iri") == iri).select(t.pk).first()
    return None if row is None else row[0]


def edit_set(db: Database, t: Table, value: Any, column: str, add: tuple = (), remove: tuple = ()) -> DataFrame:
    """Adds to and removes from a multi-valued column of one row."""
    kind = t.columns[column].spark_type
    items = lambda x: F.array(*map(F.lit, x)).cast(kind)
    own = F.coalesce(F.col(f"`{column}`"), items(()))
    return Update(db, t).set({column: F.array_except(F.array_union(own, items(add)), items(remove))}).where({t.pk: value}).returning()


class Repository:
    """list, detail, create, update and remove for one table; search looks in text columns."""

    def __init__(self, db: Database, t: Table, searchable: tuple[str, ...] = (), default_sort: Any = None, where: Any = None, transform: Callable | None = None) -> None:
        self.db, self.table, self.searchable, self.default_sort, self.base_filter, self.transform = db, t, searchable, default_sort, where, transform

    def list(self, search: str | None = None, where: Any = None, order_by: Any = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        from quadrel.functions.predicates import and_, like, or_

        word = search.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if search else None
        test = [c for c in (self.base_filter, where, or_(*(like(self.table.c[n], f"%{word}%") for n in self.searchable)) if search else None) if c is not None]
        order = order_by or self.default_sort
        df = self.db.query(self.table).find_many(where=and_(*test) if test else None, order_by=order or (), limit=limit, offset=offset)
        return self.transform(df) if self.transform else df

    def detail(self, value: Any) -> Any:
        return self.db.query(self.table).find_by_id(value).first()

    def create(self, values: Mapping[str, Any]) -> DataFrame:
        return Insert(self.db, self.table).values(values).returning()

    def update(self, value: Any, values: Mapping[str, Any]) -> DataFrame:
        return update_by_id(self.db, self.table, value, values)

    def remove(self, value: Any) -> DataFrame:
        return delete_by_id(self.db, self.table, value)
