"""Wide rows to quads and back. A quad is g, s, p, o_kind, o, o_dt, o_lang."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.operators.identity import document_of
from quadrel.schema import Column, Table

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
QUAD = "g string, s string, p string, o_kind string, o string, o_dt string, o_lang string"
# Declared kind -> datatype of its literals.
DATATYPES = {
    **{k: XSD + "integer" for k in ("integer", "int", "smallint", "tinyint", "mediumint", "bigint", "serial")},
    **{k: XSD + "double" for k in ("real", "float", "double")}, **{k: XSD + "decimal" for k in ("decimal", "numeric")},
    "boolean": XSD + "boolean", **{k: XSD + "dateTime" for k in ("date", "datetime", "timestamp")}, **{k: XSD + "json" for k in ("json", "jsonb")},
}


def lexical(c: Column, value: SparkColumn) -> SparkColumn:
    """A value as the text of its literal; times in UTC with milliseconds."""
    if DATATYPES.get(c.kind) == XSD + "dateTime":
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return value.cast("string")


def typed(c: Column, text: SparkColumn) -> SparkColumn:
    if DATATYPES.get(c.kind) == XSD + "dateTime":
        return F.to_timestamp(text)
    return text.cast(c.spark_type.elementType if c.is_array else c.spark_type)


def is_iri(c: Column) -> bool:
    return c.kind in ("uri", "iri") or c.link_to is not None


def _quad(s: SparkColumn, p: str, kind: str, o: SparkColumn, dt: str | None) -> SparkColumn:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), o.alias("o"), F.lit(dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def _quad_of(t: Table, n: str, kind: str, dt: str | None) -> Callable[[SparkColumn], SparkColumn]:
    """From a value of column n to its quad; inverse ones point from the value to the row."""
    c, p, iri = t.columns[n], t.predicate_of(n), F.col("_iri")
    if c.is_inverse:
        return lambda v: _quad(v.cast("string"), p, "iri", iri, None)
    return lambda v: _quad(iri, p, kind, lexical(c, v), dt)


def wide_to_quads(df: DataFrame, t: Table) -> DataFrame:
    """Rows of t (with _iri) as quads: one for the class, one for each value that isn't null. No shuffle."""
    iri = F.col("_iri")

    made = [F.array(_quad(iri, RDF_TYPE, "iri", F.lit(t.type_iri), None))]
    for n, c in t.columns.items():
        if c.primary and not c.predicate_iri:
            continue
        kind, dt = ("iri", None) if is_iri(c) else ("literal", DATATYPES.get(c.kind, XSD + "string"))
        one = _quad_of(t, n, kind, dt)
        made.append(F.transform(F.array_distinct(F.col(f"`{n}`")), one) if c.is_array else F.array(one(F.col(f"`{n}`"))))
    rows = df.select(document_of(iri).alias("g"), F.explode(F.flatten(F.filter(F.array(*made), lambda a: a.isNotNull()))).alias("q"))
    return rows.select("g", "q.*").filter("o is not null and s is not null")


def graph_scan(quads: DataFrame, graphs: list[str] | str | None = None) -> DataFrame:
    """The quads of one graph, of several, or of all."""
    if graphs is None:
        return quads
    return quads.filter(F.col("g").isin([graphs] if isinstance(graphs, str) else list(graphs)))


def type_scan(quads: DataFrame, t: Table, graphs: list[str] | str | None = None) -> DataFrame:
    """Rows of t out of quads: one conditional aggregation by subject, so one shuffle for any number of columns.

    Several values of a scalar column: the smallest text counts. Arrays come back sorted, without repeats.
    """
    q = graph_scan(quads, graphs)
    forward = {n: c for n, c in t.columns.items() if not c.is_inverse and not (c.primary and not c.predicate_iri)}
    used = q.filter(F.col("p").isin([RDF_TYPE, *(t.predicate_of(n) for n in forward)]))
    hold = [F.max((F.col("p") == RDF_TYPE) & (F.col("o") == t.type_iri)).alias("_is")]
    for n, c in forward.items():
        value = F.when(F.col("p") == t.predicate_of(n), F.col("o"))
        hold.append((F.collect_set(value) if c.is_array else F.min(value)).alias(f"_v_{n}"))
    rows = used.groupBy("s").agg(*hold).filter("_is")
    for n, c in t.columns.items():
        if c.is_inverse:
            back = q.filter(F.col("p") == t.predicate_of(n)).groupBy(F.col("o").alias("s")).agg((F.array_sort(F.collect_set("s")) if c.is_array else F.min("s")).alias(f"_v_{n}"))
            rows = rows.join(back, "s", "left")
    out = []
    for n, c in t.columns.items():
        if c.primary and not c.predicate_iri:
            short = F.regexp_extract("s", _id_pattern(t), 1)
            out.append(F.when(short != "", short).otherwise(F.col("s")).cast(c.spark_type).alias(n))
        elif c.is_array and not c.is_inverse:
            out.append(F.array_sort(F.transform(f"_v_{n}", partial(typed, c))).alias(n))
        else:
            out.append((F.col(f"_v_{n}") if c.is_inverse else typed(c, F.col(f"_v_{n}"))).alias(n))
    return rows.select(*out, F.col("s").alias("_iri"))


def _id_pattern(t: Table) -> str:
    import re

    from quadrel.operators.identity import joint, parts

    pattern = "^"
    for text, how in parts(joint(t.base, t.template)):
        pattern += re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text) if how is None else "(.+?)" if text == "{id" else ".+?"
    return pattern + "$"


def conflicting_values(quads: DataFrame, t: Table) -> DataFrame:
    """Data quality: subject and predicate of scalar columns that hold several values."""
    scalar = [t.predicate_of(n) for n, c in t.columns.items() if not c.is_array and not c.is_inverse and not c.primary]
    return quads.filter(F.col("p").isin(scalar)).groupBy("s", "p").agg(F.count_distinct("o").alias("n_values")).filter("n_values > 1")


def read_subject(quads: DataFrame, iri: str, graph: str | None = None) -> DataFrame:
    """All quads of one subject."""
    return graph_scan(quads, graph).filter(F.col("s") == iri)
