"""Keys for rows that come without one: random local keys, and templates around them."""

from __future__ import annotations

import re
import secrets

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.operators.identity import DATE_PARTS, TIME_COLUMNS, document_of, slug
from quadrel.schema import Table
from quadrel.sources.layout import written

LENGTH = 21
_HOLE = re.compile(r"\{\s*([^{}|\[\]]+?)\s*(?:\|\s*(\w+)\s*)?(?:\[\s*(-?\d*)\s*(:?)\s*(-?\d*)\s*\])?\s*\}")


def local_key(seed: SparkColumn) -> SparkColumn:
    """LENGTH URL-safe characters out of a seed that is another one for each row."""
    raw = F.base64(F.unhex(F.sha2(seed, 256)))
    return F.left(F.translate(raw, "+/", "-_"), F.lit(LENGTH))


def key_of(ref: SparkColumn) -> SparkColumn:
    """The local key of a resource: its fragment unless that only says "this", else its file's or folder's name."""
    fragment, doc = F.substring_index(ref, "#", -1), F.regexp_replace(document_of(ref), "/+$", "")
    index = F.regexp_extract(doc, r"(?:^|/)([^/]+)/index\.(?:ttl|jsonld|json)$", 1)
    name = F.regexp_replace(F.substring_index(doc, "/", -1), r"\.(?:ttl|jsonld|json)$", "")
    own = F.when(F.contains(ref, F.lit("#")) & ~fragment.isin("", "this", "me", "it"), fragment)
    return F.coalesce(own, F.when(index != "", index).otherwise(name))


def folder_of(ref: SparkColumn) -> SparkColumn:
    """The folder that a resource owns: without date folders, without an index file, or its file's name without the ending."""
    doc = document_of(ref)
    dated = F.regexp_extract(doc, r"^(.+)/\d{4}/\d{2}/\d{2}/[^/]+\.(?:ttl|jsonld|json)$", 1)
    index = F.regexp_extract(doc, r"^(.+)/index\.(?:ttl|jsonld|json)$", 1)
    file = F.regexp_extract(doc, r"^(.+)\.(?:ttl|jsonld|json)$", 1)
    above = F.regexp_replace(doc, "/[^/]*$", "")
    return F.coalesce(*(F.when(x != "", x) for x in (dated, index, file)), above)


_PROPERTIES = {"key": key_of, "id": lambda r: F.regexp_replace(r, r"^.*[/#]", ""), "doc": document_of, "document": document_of, "dir": folder_of, "owner": folder_of, "resource": lambda r: r, "slug": slug}


def render_key(template: str, of: dict[str, SparkColumn], key: SparkColumn) -> SparkColumn:
    """A default id: {key} is the local key, {yyyy} {MM} {dd} come from the row's time, else from now (UTC).

    {column} is a value (null: empty); {column.key}, {column|slug} and the like are parts of the resource it
    names, {column[1]} and {column[0:2]} segments of its path.
    """
    if re.search(r"\{\s*id\s*\}", template):
        raise ValueError("an id template takes {key} for the generated key; {id} is what it makes")
    time = F.coalesce(*(of[c].cast("timestamp") for c in TIME_COLUMNS if c in of), F.current_timestamp())
    out, at = [], 0
    for m in _HOLE.finditer(template):
        out.append(F.lit(template[at : m.start()]))
        at = m.end()
        path, how, start, colon, end = m.groups()
        name, _, part = path.partition(".")
        if path == "key":
            value = key
        elif path in DATE_PARTS:
            value = F.date_format(time, DATE_PARTS[path])
        elif name not in of:
            raise ValueError(f"id template {template!r} needs a value for {name!r}")
        else:
            value = of[name].cast("string")
        for step in (part, how):
            if step and step not in _PROPERTIES:
                raise ValueError(f"unknown part {step!r} in id template {template!r}")
            value = _PROPERTIES[step](value) if step else value
        if start is not None:
            value = _segments(value, start, bool(colon), end)
        out.append(F.coalesce(value, F.lit("")))
    return F.concat(*out, F.lit(template[at:]))


def _segments(value: SparkColumn, start: str, many: bool, end: str) -> SparkColumn:
    parts = F.filter(F.split(F.regexp_replace(value, "#", "/"), "/"), lambda s: s != "")
    n = F.size(parts)
    at = lambda k, default: default if k == "" else F.lit(int(k)) if int(k) >= 0 else n + int(k)
    if not many:
        return F.get(parts, at(start, F.lit(0)))
    low, high = at(start, F.lit(0)), at(end, n)
    return F.array_join(F.slice(parts, F.greatest(low, F.lit(0)) + 1, F.greatest(F.least(high, n) - low, F.lit(0))), "/")


def generated(t: Table) -> bool:
    """Whether rows of t may come without a key: it is text, and its default, if any, is a template."""
    c = t.columns[t.pk]
    return c.spark_type.simpleString() == "string" and (c.default_value is None or isinstance(c.default_value, str))


def with_keys(t: Table, df: DataFrame) -> DataFrame:
    """df with a key where a row has none. New keys are written out, as they must not change when the plan runs again."""
    c, seed = t.columns[t.pk], secrets.token_hex(16)
    own = F.col(f"`{t.pk}`") if t.pk in df.columns else F.lit(None).cast("string")
    others = {n: F.col(f"`{n}`") for n in df.columns if n != t.pk}
    key = local_key(F.concat_ws("/", F.lit(seed), F.spark_partition_id().cast("string"), F.monotonically_increasing_id().cast("string")))
    made = render_key(c.default_value, others, key) if c.default_value else key
    return written(df.withColumn(t.pk, F.coalesce(own, made)), "keyed")
