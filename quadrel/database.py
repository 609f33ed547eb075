"""The facade: which DataFrame stands behind each table, and the ways to query and change it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.operators.identity import iri_column, names
from quadrel.operators.relational import Finder
from quadrel.plans.select import Select
from quadrel.schema import Relation, Table


class _Frames(dict):
    """Table name -> DataFrame; those in `later` are opened when they are first asked for."""

    def __init__(self, *args: Any) -> None:
        super().__init__(*args)
        self.later: dict[str, Callable[[], DataFrame]] = {}

    def __missing__(self, name: str) -> DataFrame:
        if name not in self.later:
            raise KeyError(name)
        self[name] = self.later[name]()
        return self[name]

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or name in self.later

    def get(self, name: str, default: Any = None) -> Any:
        return self[name] if name in self else default

    def copy(self) -> _Frames:
        new = _Frames(self)
        new.later = dict(self.later)
        return new


def _stored(t: Table, df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c.source or n}`").alias(n) for n, c in t.columns.items()))


class Database:
    """Tables are bound to wide DataFrames, or read out of one DataFrame of quads."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, unique: bool = False) -> None:
        """unique: no statement of the quads stands in two graphs, nor twice in one, so SPARQL patterns need no distinct."""
        self.spark, self.quads, self.unique = spark, quads, unique
        self.frames = _Frames()
        self.relations: dict[str, dict[str, Relation]] = {}
        self.sources: dict[str, DataFrame] = {}
        self.stores: dict[str, Any] = {}
        self.errors: DataFrame | None = None

    def bind(self, t: Table, df: DataFrame) -> Database:
        """The table's rows; columns are found by their stored names."""
        self.frames[t.name] = _stored(t, df)
        return self

    def bind_later(self, t: Table, read: Callable[[], DataFrame]) -> Database:
        """As bind(), but read() opens the rows once a query needs them."""
        self.frames.later[t.name] = lambda: _stored(t, read())
        return self

    def replace_quads(self, quads: DataFrame, unique: bool = False) -> Database:
        self.quads, self.unique = quads, unique
        return self

    def load_quads(self, *tables: Table) -> Database:
        """The rows of bound tables as the database's quads. Keys are unique and values stand once, so statements do too."""
        from functools import reduce

        from quadrel.operators.quads import wide_to_quads

        return self.replace_quads(reduce(lambda a, b: a.unionByName(b), (wide_to_quads(self.frame(t), t) for t in tables)), True)

    def bind_store(self, t: Table, path: str, format: str = "parquet") -> Database:
        """The table's rows at path; changes are written there, and read back, so plans do not pile up."""
        from quadrel.sources.store import Store

        self.stores[t.name] = Store(self.spark, t, path, format)
        self.frames[t.name] = self.stores[t.name].read()
        return self

    def put(self, t: Table, rows: DataFrame, added: DataFrame | None = None) -> None:
        """The table's next version; `added`, where rows were only added, is all that a store has to write."""
        store = self.stores.get(t.name)
        if store is None:
            self.frames[t.name] = rows
            return
        store.append(added) if added is not None else store.replace(rows)
        self.frames[t.name] = store.read()

    def relate(self, t: Table, **relations: Relation) -> Database:
        self.relations.setdefault(t.name, {}).update(relations)
        return self

    def frame(self, t: Table, prefix: bool = False) -> DataFrame:
        """The table's columns and _iri; prefixed, each is named alias__column."""
        if t.name in self.frames:
            df = self.frames[t.name]
        elif self.quads is not None:
            from quadrel.operators.quads import type_scan

            df = type_scan(self.quads, t)
        else:
            raise ValueError(f"nothing is bound to table {t.name}")
        if "_iri" not in df.columns:
            of = {n: F.col(f"`{n}`") for n in t.columns}
            ready = all(n in of or n in ("id", "yyyy", "MM", "dd", "HH", "mm", "ss") for n in names(t.template))
            df = df.withColumn("_iri", iri_column(t, of) if ready else F.lit(None).cast("string"))
        return df.select(*(F.col(f"`{c}`").alias(f"{t.alias_name}__{c}") for c in df.columns)) if prefix else df

    def select(self, fields: Mapping[str, Any] | None = None, **more: Any) -> Select:
        return Select(self, {**(fields or {}), **more} if fields is not None or more else None)

    def query(self, t: Table) -> Finder:
        return Finder(self, t)

    def insert(self, t: Table) -> Any:
        from quadrel.operators.mutations import Insert

        return Insert(self, t)

    def update(self, t: Table) -> Any:
        from quadrel.operators.mutations import Update

        return Update(self, t)

    def delete(self, t: Table) -> Any:
        from quadrel.operators.mutations import Delete

        return Delete(self, t)

    def sparql(self, text: str) -> DataFrame:
        """A SPARQL query or update over the quads; an update replaces them and returns nothing but its counts."""
        from quadrel.sparql import run

        return run(self, text)

    def batch(self, *steps: Callable[[Database], Any]) -> list[Any]:
        """Steps one after the other; what ran before a failure stays."""
        return [step(self) for step in steps]

    def transaction(self, work: Callable[[Database], Any]) -> Any:
        """All of the work or none: DataFrames do not change, so the old ones are put back on failure."""
        before, quads, unique = self.frames.copy(), self.quads, self.unique
        try:
            return work(self)
        except BaseException:
            self.frames, self.quads, self.unique = before, quads, unique
            raise

    def add_source(self, name: str, df: DataFrame) -> None:
        self.sources[name] = df
        df.createOrReplaceTempView(name)

    def add_sources_from_index(self, rows: DataFrame, rdf_class: str, read: Callable[[str], DataFrame]) -> list[str]:
        """A source for each container that an index (rdf_class, container) has for the class; returns their names. Containers of one class are few."""
        found = [r[0] for r in rows.filter(F.col("rdf_class") == rdf_class).select("container").distinct().orderBy("container").collect()]
        names = [f"source_{len(self.sources) + k}" for k in range(len(found))]
        for name, container in zip(names, found, strict=True):
            self.add_source(name, read(container))
        return names

    def list_sources(self) -> list[str]:
        return sorted(self.sources)

    def remove_source(self, name: str) -> None:
        self.sources.pop(name, None)
        self.spark.catalog.dropTempView(name)
