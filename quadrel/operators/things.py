"""Single subjects in a frame of quads: create, read, update, delete, batches; links of a profile; inline children."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.operators.identity import document_of, is_absolute
from quadrel.operators.quads import QUAD, XSD
from quadrel.sources.layout import written


def _object(value: Any) -> tuple[str, str, str | None]:
    if isinstance(value, bool):
        return "literal", str(value).lower(), XSD + "boolean"
    if isinstance(value, int):
        return "literal", str(value), XSD + "integer"
    if isinstance(value, float):
        return "literal", repr(value), XSD + "double"
    if hasattr(value, "isoformat"):
        return "literal", value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{value.microsecond // 1000:03d}Z", XSD + "dateTime"
    return ("iri", value, None) if is_absolute(value) and "://" in value else ("literal", str(value), XSD + "string")


def _rows(quads: DataFrame, iri: str, values: Mapping[str, Any]) -> DataFrame:
    each = [(p, x) for p, v in values.items() for x in (v if isinstance(v, list | tuple | set) else [v]) if x is not None]
    data = [(iri.split("#")[0], iri, p, kind, o, dt, None) for p, x in each for kind, o, dt in [_object(x)]]
    return quads.sparkSession.createDataFrame(data, QUAD).distinct()


def create_thing(quads: DataFrame, iri: str, values: Mapping[str, Any]) -> DataFrame:
    """The quads with the subject's statements added. values: predicate -> value or list; times are taken as UTC."""
    if not quads.filter(F.col("s") == iri).isEmpty():
        raise ValueError(f"{iri} exists already")
    return quads.unionByName(_rows(quads, iri, values))


def read_thing(quads: DataFrame, iri: str) -> DataFrame:
    """p and the sorted values of each predicate."""
    return quads.filter(F.col("s") == iri).groupBy("p").agg(F.array_sort(F.collect_set("o")).alias("values"))


def update_thing(quads: DataFrame, iri: str, values: Mapping[str, Any]) -> DataFrame:
    """The given predicates take the new values; None clears one; others stay."""
    return quads.filter(~((F.col("s") == iri) & F.col("p").isin(list(values)))).unionByName(_rows(quads, iri, values))


def delete_thing(quads: DataFrame, iri: str) -> DataFrame:
    return quads.filter(F.col("s") != iri)


def batch_things(quads: DataFrame, steps: Iterable[tuple[str, str, Mapping[str, Any] | None]]) -> DataFrame:
    """Steps ("create" | "update" | "delete", iri, values) in order; all or none, as quads do not change."""
    for what, iri, values in steps:
        quads = {"create": create_thing, "update": update_thing}[what](quads, iri, values or {}) if what != "delete" else delete_thing(quads, iri)
    return quads


# ---- links of a profile


def add_link(quads: DataFrame, profile: str, predicate: str, target: str) -> DataFrame:
    """A link that is there already stays once."""
    return quads if is_linked(quads, profile, predicate, target) else quads.unionByName(_rows(quads, profile, {predicate: target}))


def remove_link(quads: DataFrame, profile: str, predicate: str, target: str) -> DataFrame:
    return quads.filter(~((F.col("s") == profile) & (F.col("p") == predicate) & (F.col("o") == target)))


def list_links(quads: DataFrame, profile: str, predicate: str) -> DataFrame:
    return quads.filter((F.col("s") == profile) & (F.col("p") == predicate) & (F.col("o_kind") == "iri")).select(F.col("o").alias("target")).distinct()


def is_linked(quads: DataFrame, profile: str, predicate: str, target: str) -> bool:
    return not list_links(quads, profile, predicate).filter(F.col("target") == target).isEmpty()


# ---- inline children


def delete_with_children(quads: DataFrame, subjects: DataFrame, inline: list[str]) -> DataFrame:
    """The quads without the subjects (column s) and all that hangs on them by inline predicates, level by level.

    A child goes if it is a blank node or stands in its parent's document. Each level is written out.
    """
    gone = level = written(subjects.select("s").distinct(), "gone")
    own = (F.col("o_kind") == "blank") | (F.col("o_kind") == "iri") & (document_of(F.col("s")) == document_of(F.col("o")))
    held = quads.filter(F.col("p").isin(inline) & own).select("s", "o").distinct()
    while inline and not level.isEmpty():
        below = held.join(level, "s", "left_semi")
        level = written(below.select(F.col("o").alias("s")).distinct().join(gone, "s", "left_anti"), "gone")
        gone = gone.unionByName(level)
    return quads.join(gone, "s", "left_anti").select(*quads.columns)
