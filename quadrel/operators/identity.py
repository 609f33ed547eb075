"""Subject IRIs from templates and back, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.schema import Column, Table

_HOLE = re.compile(r"\{([^}|]+)(?:\|(\w+))?\}")
# Date parts of templates, and the columns that may hold the time.
DATE_PARTS = {"yyyy": "yyyy", "MM": "MM", "dd": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}
TIME_COLUMNS = ("createdAt", "created_at", "dateCreated")
ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


def is_absolute(value: object) -> bool:
    return isinstance(value, str) and re.match(ABSOLUTE, value) is not None


def _normal_form(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


_nfkc = F.pandas_udf(_normal_form, T.StringType())


def slug(text: SparkColumn) -> SparkColumn:
    """Normal form NFKC, lower case, runs of what is no letter or digit as one dash, none at the ends.

    Python sees only values that aren't ASCII.
    """
    text = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(_nfkc(text))
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def parts(template: str) -> list[tuple[str, str | None]]:
    """('text', None) and ('{name', transform) in order."""
    found, at = [], 0
    for m in _HOLE.finditer(template):
        if m.start() > at:
            found.append((template[at : m.start()], None))
        found.append(("{" + m[1], m[2] or ""))
        at = m.end()
    return found + ([(template[at:], None)] if at < len(template) else [])


def names(template: str) -> list[str]:
    return [p[1:] for p, how in parts(template) if how is not None]


def joint(base: str, template: str) -> str:
    """base and template as one: a template that begins with # follows directly."""
    if is_absolute(template) or not base:
        return template
    return base + template if template.startswith("#") or base.endswith(("/", "#")) else f"{base}/{template}"


def render(template: str, of: dict[str, SparkColumn], time: SparkColumn | None = None) -> SparkColumn:
    """The template with each {name} from `of`; date parts come from `time` (UTC)."""
    out = []
    for text, how in parts(template):
        if how is None:
            out.append(F.lit(text))
            continue
        name = text[1:]
        if name in of:
            value = of[name].cast("string")
        elif name in DATE_PARTS and time is not None:
            value = F.date_format(time, DATE_PARTS[name])
        else:
            raise ValueError(f"template {template!r} needs a value for {name!r}")
        if how == "slug":
            value = slug(value)
        elif how == "id":
            value = F.regexp_replace(value, r"^.*[/#]", "")
        elif how:
            raise ValueError(f"unknown transform {how!r} in template {template!r}")
        out.append(value)
    return F.concat(*out)


def iri_column(t: Table, of: dict[str, SparkColumn]) -> SparkColumn:
    """The subject IRI of a row; an id that is an IRI already stays. of: values by column name."""
    pk = of[t.pk].cast("string")
    values = {**of, "id": pk}
    time = next((of[c] for c in TIME_COLUMNS if c in of), None)
    made = render(joint(t.base, t.template), values, time)
    return F.when(pk.rlike(ABSOLUTE), pk).otherwise(made) if t.columns[t.pk].spark_type.simpleString() == "string" else made


def iri_of(t: Table, value: object) -> str:
    """The IRI for one short id."""
    if is_absolute(value):
        return str(value)
    free = [n for n in names(t.template) if n != "id"]
    if free:
        raise ValueError(f"{t.name}: an id alone does not place a row, {', '.join(free)} missing")
    return joint(t.base, t.template).replace("{id}", str(value))


def link_value(target: object, value: object) -> object:
    """What a link column stores for a short id."""
    if is_absolute(value) or not isinstance(value, str | int):
        return value
    if isinstance(target, Table):
        return iri_of(target, value)
    return f"{target}{value}" if is_absolute(target) else value


def extract(iri: SparkColumn, base: str, template: str) -> dict[str, SparkColumn]:
    """The template's variables out of an IRI; empty text where it doesn't fit."""
    pattern, order = "^", []
    for text, how in parts(joint(base, template)):
        if how is None:
            pattern += re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)
        else:
            pattern += "(.+?)"
            order.append(text[1:])
    return {n: F.regexp_extract(iri, pattern + "$", k + 1) for k, n in enumerate(order)}


def fragment_of(iri: SparkColumn) -> SparkColumn:
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1))


def document_of(iri: SparkColumn) -> SparkColumn:
    """The IRI without its fragment."""
    return F.substring_index(iri, "#", 1)


def pruning_filter(t: Table, equal: dict[str, object]) -> dict[str, object]:
    """Of known equalities, those on template variables: filters on the layout's partition columns."""
    return {n: equal[n] for n in names(t.template) if n in equal}


def with_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """The batch's row number, from 1; for small insert batches."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def path_pick(value: SparkColumn, start: int, end: int | None = None) -> SparkColumn:
    """Segments of a path: one, or from start up to (not with) end; negative ones count from the end."""
    segments = F.filter(F.split(value, "/"), lambda s: s != "")
    n = F.size(segments)
    at = lambda k: F.lit(k) if k >= 0 else n + k
    if end is None:
        return F.try_element_at(segments, at(start) + 1)
    return F.array_join(F.slice(segments, at(start) + 1, F.greatest(at(end) - at(start), F.lit(0))), "/")


def spark_value(c: Column, value: SparkColumn) -> SparkColumn:
    return value.cast(c.spark_type)
