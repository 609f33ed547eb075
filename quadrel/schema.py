"""Tables, columns, reusable schemas and relations: what a query is declared against."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

# Declared kind -> Spark type. Fractions keep their fraction.
SPARK_TYPES: dict[str, T.DataType] = {
    **{k: T.StringType() for k in ("string", "text", "varchar", "char", "uri", "iri", "json", "jsonb", "id")},
    **{k: T.LongType() for k in ("integer", "int", "smallint", "tinyint", "mediumint", "bigint", "serial")},
    **{k: T.DoubleType() for k in ("real", "float", "double")},
    **{k: T.DecimalType(38, 18) for k in ("decimal", "numeric")},
    "boolean": T.BooleanType(),
    **{k: T.TimestampType() for k in ("date", "datetime", "timestamp")},
    "object": T.MapType(T.StringType(), T.StringType()),
}
EXAMPLE_NS = "http://example.org/"


@dataclass(frozen=True)
class Column:
    """A declared column. `source` names the stored column where it differs from `name`."""

    kind: str
    name: str = ""
    predicate_iri: str | None = None
    source: str | None = None
    required: bool = False
    primary: bool = False
    is_array: bool = False
    is_inverse: bool = False
    link_to: Any = None
    default_value: Any = None

    def __post_init__(self) -> None:
        if self.kind not in SPARK_TYPES:
            raise ValueError(f"unknown column kind {self.kind!r}")

    def predicate(self, iri: str) -> Column:
        return replace(self, predicate_iri=iri)

    def stored_as(self, name: str) -> Column:
        return replace(self, source=name)

    def not_null(self) -> Column:
        return replace(self, required=True)

    def primary_key(self) -> Column:
        return replace(self, primary=True, required=True)

    def array(self) -> Column:
        """Several values without order: compared and stored as a set."""
        return replace(self, is_array=True)

    def inverse(self) -> Column:
        """The value is the subject of the triple that points here."""
        return replace(self, is_inverse=True)

    def link(self, target: Any) -> Column:
        """The value is the IRI of a row of target (a table, a table's name, or an IRI prefix)."""
        return replace(self, link_to=target)

    def default(self, value: Any) -> Column:
        """A constant, a Spark column, or a function without arguments that makes one of them."""
        return replace(self, default_value=value)

    @property
    def spark_type(self) -> T.DataType:
        own = SPARK_TYPES[self.kind]
        return T.ArrayType(own) if self.is_array else own


def column(kind: str, **more: Any) -> Column:
    return Column(kind, **more)


def string(**more: Any) -> Column:
    return Column("string", **more)


def integer(**more: Any) -> Column:
    return Column("integer", **more)


def double(**more: Any) -> Column:
    return Column("double", **more)


def boolean(**more: Any) -> Column:
    return Column("boolean", **more)


def timestamp(**more: Any) -> Column:
    return Column("timestamp", **more)


def uri(**more: Any) -> Column:
    return Column("uri", **more)


def key(kind: str = "id", **more: Any) -> Column:
    return Column(kind, **more).primary_key()


@dataclass(frozen=True)
class Ref:
    """A column of a table under an alias; alias None is an output name."""

    alias: str | None
    name: str
    column: Column | None = field(default=None, compare=False)


class _Columns:
    def __init__(self, table: Table) -> None:
        self._table = table

    def __getattr__(self, name: str) -> Ref:
        return self[name]

    def __getitem__(self, name: str) -> Ref:
        t = self._table
        if name == "_iri":
            return Ref(t.alias_name, "_iri")
        if name not in t.columns:
            raise AttributeError(f"{t.alias_name} has no column {name!r}")
        return Ref(t.alias_name, name, t.columns[name])


@dataclass(frozen=True)
class Table:
    """A named table: columns, RDF class, base IRI and template of its subjects."""

    name: str
    columns: Mapping[str, Column]
    type_iri: str
    base: str = ""
    template: str = "{id}"
    namespace: str | None = None
    alias_name: str = ""
    hooks: Mapping[str, Callable] = field(default_factory=dict, compare=False, hash=False)

    @property
    def c(self) -> _Columns:
        return _Columns(self)

    @property
    def pk(self) -> str:
        return next(n for n, c in self.columns.items() if c.primary)

    def predicate_of(self, name: str) -> str:
        own = self.columns[name].predicate_iri
        return own or (self.namespace or EXAMPLE_NS) + name

    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(n, c.spark_type, not c.required) for n, c in self.columns.items()])

    def __hash__(self) -> int:
        return hash((self.name, self.alias_name))


def table(name: str, columns: Mapping[str, Column], type_iri: str, **more: Any) -> Table:
    """Declares a table; it needs an RDF class and exactly one primary key."""
    if not type_iri:
        raise ValueError(f"table {name} needs an RDF class")
    own = {n: replace(c, name=n) for n, c in columns.items()}
    if sum(c.primary for c in own.values()) != 1:
        raise ValueError(f"table {name} needs exactly one primary key")
    if not more.get("namespace") and any(not c.predicate_iri and not c.primary for c in own.values()):
        raise ValueError(f"table {name} needs a namespace, or a predicate for each column")
    return Table(name, own, type_iri, alias_name=more.pop("alias_name", name), **more)


def alias(t: Table, name: str) -> Table:
    """The same table under another name, for self joins."""
    return replace(t, alias_name=name)


@dataclass(frozen=True)
class Schema:
    """Columns and class without a place: bound to tables, extended by others."""

    columns: Mapping[str, Column]
    type_iri: str
    namespace: str | None = None
    sub_class_of: tuple[str, ...] = ()

    def extend(self, columns: Mapping[str, Column], type_iri: str) -> Schema:
        """Own columns win over inherited ones; the parents' classes are kept."""
        return Schema({**self.columns, **columns}, type_iri, self.namespace, (self.type_iri, *self.sub_class_of))

    def bind(self, name: str, **more: Any) -> Table:
        return table(name, self.columns, self.type_iri, namespace=self.namespace, **more)


@dataclass(frozen=True)
class Relation:
    """kind one or many; fields of the parent that match references of the child, or discover for remote rows."""

    kind: str
    target: Table
    fields: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    discover: Callable | None = None


def one(target: Table, fields: tuple[str, ...] = (), references: tuple[str, ...] = ()) -> Relation:
    return Relation("one", target, fields, references)


def many(target: Table, fields: tuple[str, ...] = (), references: tuple[str, ...] = (), discover: Callable | None = None) -> Relation:
    return Relation("many", target, fields, references, discover)


def extend_namespace(base: str, terms: Mapping[str, str]) -> dict[str, str]:
    """Term name -> IRI."""
    return {k: base + v for k, v in terms.items()}
