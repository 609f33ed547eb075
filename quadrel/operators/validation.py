"""Shapes: constraints on columns, checked as one expression for each; SHACL text in and out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.operators.quads import DATATYPES, XSD, is_iri
from quadrel.schema import Column, Table, table

SH = "http://www.w3.org/ns/shacl#"
# Datatype -> declared kind.
KIND_OF = {XSD + "string": "string", XSD + "integer": "integer", XSD + "int": "integer", XSD + "long": "integer", XSD + "decimal": "decimal", XSD + "double": "double", XSD + "float": "double", XSD + "boolean": "boolean", XSD + "dateTime": "datetime", XSD + "date": "datetime", XSD + "json": "json", XSD + "anyURI": "uri"}


@dataclass(frozen=True)
class Constraint:
    path: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    node_kind: str | None = None
    pattern: str | None = None
    predicate: str | None = None


@dataclass(frozen=True)
class Shape:
    target_class: str
    constraints: tuple[Constraint, ...]


def _tests(c: Constraint, kind: T.DataType) -> list[tuple[str, SparkColumn, str]]:
    """(constraint, what breaks it, message)"""
    value = F.col(f"`{c.path}`")
    many = isinstance(kind, T.ArrayType)
    n = F.coalesce(F.size(value), F.lit(0)) if many else value.isNotNull().cast("int")
    any_of = lambda test: F.coalesce(F.exists(value, test), F.lit(False)) if many else F.coalesce(test(value), F.lit(False))
    found = []
    if c.min_count is not None:
        found.append(("minCount", n < c.min_count, f"needs at least {c.min_count} value(s)"))
    if c.max_count is not None:
        found.append(("maxCount", n > c.max_count, f"takes at most {c.max_count} value(s)"))
    if c.datatype:
        target = {"integer": "bigint", "double": "double", "decimal": "decimal(38,18)", "boolean": "boolean", "datetime": "timestamp"}.get(KIND_OF.get(c.datatype, "string"))
        if target:
            found.append(("datatype", any_of(lambda v: v.isNotNull() & v.cast("string").try_cast(target).isNull()), f"is no {c.datatype.removeprefix(XSD)}"))
    if c.node_kind == "IRI":
        found.append(("nodeKind", any_of(lambda v: ~v.cast("string").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")), "is no IRI"))
    elif c.node_kind == "Literal":
        found.append(("nodeKind", any_of(lambda v: v.cast("string").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")), "is no literal"))
    if c.pattern:
        found.append(("pattern", any_of(lambda v: ~v.cast("string").rlike(c.pattern)), f"does not match {c.pattern}"))
    return found


def violations(df: DataFrame, shape: Shape, key: str) -> DataFrame:
    """key, path, constraint, value, message: a row for each broken constraint. One pass, no shuffle."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    made = [
        F.when(broken, F.struct(F.lit(c.path).alias("path"), F.lit(name).alias("constraint"), F.col(f"`{c.path}`").cast("string").alias("value"), F.lit(message).alias("message")))
        for c in shape.constraints for name, broken, message in _tests(c, kinds[c.path])
    ]
    if not made:
        return df.select(F.col(f"`{key}`")).limit(0).selectExpr(f"`{key}`", "'' path", "'' constraint", "'' value", "'' message")
    return df.select(F.col(f"`{key}`"), F.inline(F.filter(F.array(*made), lambda v: v.isNotNull())))


def shape_of(t: Table) -> Shape:
    """The shape that a table's declaration implies."""
    made = []
    for n, c in t.columns.items():
        if c.is_inverse:
            continue
        made.append(Constraint(n, 1 if c.required else None, None if c.is_array else 1, None if is_iri(c) else DATATYPES.get(c.kind, XSD + "string"), "IRI" if is_iri(c) else None, None, t.predicate_of(n)))
    return Shape(t.type_iri, tuple(made))


def table_of(shape: Shape, name: str, base: str = "", pk: str = "id") -> Table:
    """A table out of a shape; the key is added if no path has its name."""
    columns = {pk: Column("id").primary_key()}
    for c in shape.constraints:
        kind = "uri" if c.node_kind == "IRI" else KIND_OF.get(c.datatype or "", "string")
        own = Column(kind, predicate_iri=c.predicate or c.path, required=bool(c.min_count), is_array=c.max_count is None or c.max_count > 1)
        name_of = c.path.rsplit("#", 1)[-1].rsplit("/", 1)[-1]
        if name_of != pk:
            columns[name_of] = own
    return table(name, columns, shape.target_class, base=base)


def to_shacl(shape: Shape) -> str:
    lines = [f"@prefix sh: <{SH}> .", f"<{shape.target_class}Shape> a sh:NodeShape ;", f"  sh:targetClass <{shape.target_class}>"]
    for c in shape.constraints:
        own = [f"sh:path <{c.predicate or c.path}>"]
        own += [f"sh:{k} {v}" for k, v in (("minCount", c.min_count), ("maxCount", c.max_count)) if v is not None]
        own += [f"sh:datatype <{c.datatype}>"] if c.datatype else []
        own += [f"sh:nodeKind sh:{c.node_kind}"] if c.node_kind else []
        own += ['sh:pattern "' + c.pattern.replace("\\", "\\\\").replace('"', '\\"') + '"'] if c.pattern else []
        lines[-1] += " ;"
        lines.append("  sh:property [ " + " ; ".join(own) + " ]")
    return "\n".join(lines) + " .\n"


def from_shacl(text: str) -> Shape:
    """A node shape from Turtle."""
    from quadrel.sources.rdf import parse_turtle

    quads = parse_turtle(text)
    of = lambda s, p: [o for qs, qp, o in ((q.s, q.p, q.o) for q in quads) if qs == s and qp == SH + p]
    target = next((q.o for q in quads if q.p == SH + "targetClass"), None)
    if target is None:
        raise ValueError("no shape with sh:targetClass")
    made = []
    for node in (q.o for q in quads if q.p == SH + "property"):
        one = lambda p, node=node: next(iter(of(node, p)), None)
        number = lambda p, one=one: int(v) if (v := one(p)) is not None else None
        made.append(Constraint(one("path"), number("minCount"), number("maxCount"), one("datatype"), (one("nodeKind") or "").removeprefix(SH) or None, one("pattern"), one("path")))
    return Shape(target, tuple(made))


def check_frame(t: Table, df: DataFrame, update: bool = False) -> list[str]:
    """What df's own schema lacks against t: missing required columns (unless update), and other types."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    lacking = [f"{n} is missing" for n, c in t.columns.items() if c.required and c.default_value is None and n not in kinds and not update]
    wide = lambda k: {"int": "bigint", "smallint": "bigint", "float": "double", "timestamp_ntz": "timestamp"}.get(k.simpleString(), k.simpleString())
    return lacking + [f"{n} is {wide(kinds[n])}, not {c.spark_type.simpleString()}" for n, c in t.columns.items() if n in kinds and wide(kinds[n]) != c.spark_type.simpleString()]


def row_problems(t: Table, df: DataFrame, update: bool = False) -> DataFrame:
    """row (as JSON), column and problem of values that an insert, or an update, of t does not take. One pass, no shuffle.

    An insert may lack the key and what has a default; an update may lack anything but not clear what is required.
    """
    tests = []
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    for n, c in t.columns.items():
        free = c.primary or not c.required or c.default_value is not None
        if n not in df.columns:
            if not update and not free:
                tests.append((F.lit(True), n, "is missing"))
            continue
        value = F.col(f"`{n}`")
        if c.required and (update or not free):
            tests.append((value.isNull(), n, "must have a value"))
        if not isinstance(df.schema[n].dataType, T.ArrayType | T.MapType | T.StructType) and not c.is_array and not isinstance(c.spark_type, T.MapType):
            bad = value.isNotNull() & value.cast("string").try_cast(c.spark_type).isNull()
            tests.append((bad, n, f"is no {c.kind}"))
            if is_iri(c) and c.link_to is None:
                tests.append((~value.cast("string").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), n, "is no IRI"))
        elif isinstance(df.schema[n].dataType, T.ArrayType) != c.is_array:
            tests.append((value.isNotNull(), n, "is no list" if c.is_array else "is a list"))
    for n in sorted(set(df.columns) - set(t.columns)):
        tests.append((F.lit(True), n, "is no column"))
    found = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("column"), F.lit(problem).alias("problem"))) for bad, n, problem in tests))
    if not tests:
        return df.limit(0).select(row.alias("row"), F.lit("").alias("column"), F.lit("").alias("problem"))
    return df.select(row.alias("row"), F.inline(F.filter(found, lambda x: x.isNotNull())))


def with_predicates(shape: Shape, t: Table) -> Shape:
    """Paths that are predicates renamed to the table's columns."""
    by = {t.predicate_of(n): n for n in t.columns}
    return replace(shape, constraints=tuple(replace(c, path=by.get(c.path, c.path)) for c in shape.constraints))
