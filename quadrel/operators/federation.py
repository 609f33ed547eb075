"""Rows from several sources: discovery of places, remote relations, errors kept aside."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.schema import Relation, Table

if TYPE_CHECKING:
    from quadrel.database import Database

# Kinds of failure.
FORBIDDEN, NOT_FOUND, TIMEOUT, DISCOVERY_FAILED, NETWORK_ERROR = "FORBIDDEN", "NOT_FOUND", "TIMEOUT", "DISCOVERY_FAILED", "NETWORK_ERROR"


def union_sources(sources: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """All sources' rows with the source's name; sort and limit come after, over all of them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(name, F.lit(k)) for k, df in sources.items()))


def classify(message: SparkColumn) -> SparkColumn:
    """A failure's kind from its text."""
    m = F.lower(message)
    return (
        F.when(m.rlike(r"\b(?:401|403)\b|forbidden|unauthor"), FORBIDDEN).when(m.rlike(r"\b404\b|not found"), NOT_FOUND)
        .when(m.rlike("timeout|timed out|abort"), TIMEOUT).when(m.rlike("discover"), DISCOVERY_FAILED).otherwise(NETWORK_ERROR)
    )


def discover_places(strategies: list[tuple[int, DataFrame]]) -> DataFrame:
    """rdf_class, container, shapes: containers found by any strategy, each once; shapes of all, place by the first.

    strategies: (rank, DataFrame of rdf_class, container, shape).
    """
    found = reduce(lambda a, b: a.unionByName(b), (df.select("rdf_class", "container", "shape").withColumn("rank", F.lit(k)) for k, df in strategies))
    return found.groupBy("rdf_class", "container").agg(F.array_sort(F.collect_set("shape")).alias("shapes"), F.min("rank").alias("rank"))


def remote_rows(parents: DataFrame, key: str, discover: Callable[[], SparkColumn], sources: DataFrame, rows: DataFrame, fk: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, place, row struct) for each parent, and an error table key, place, code, message.

    discover makes an array of places from a parent's columns. sources: place, ok, message. rows: place and
    the remote columns; with fk, rows whose fk equals the parent's key.
    """
    places = parents.select(F.col(f"`{key}`").alias("_key"), F.explode_outer(F.array_distinct(discover())).alias("_place"))
    known = places.join(sources.select(F.col("place").alias("_place"), F.col("ok").alias("_ok"), F.col("message").alias("_message")), "_place", "left")
    lost = F.coalesce(F.col("_ok"), F.lit(False)) == F.lit(False)
    message = F.when(F.col("_place").isNull(), "discovery gave nothing").when(F.col("_ok").isNull(), "404 not found").otherwise(F.coalesce("_message", F.lit("")))
    errors = known.filter(lost).select(F.col("_key").alias(key), F.col("_place").alias("place"), classify(message).alias("code"), message.alias("message"))
    value = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != "place")).alias("row")
    held = rows.select(F.col("place").alias("_place"), value, *([F.col(f"`{fk}`").alias("_fk")] if fk else []))
    on = [known._place == held._place] + ([F.col("_key") == F.col("_fk")] if fk else [])
    good = known.filter(~lost).join(held, reduce(lambda a, b: a & b, on)).select(F.col("_key").alias(key), known._place.alias("place"), "row")
    return good, errors


def attach_remote(db: Database, df: DataFrame, parent: Table, name: str, rel: Relation) -> DataFrame:
    """df with an array of remote rows; failures go to db.errors, the parents stay."""
    sources = db.sources.get("sources")
    rows = db.sources.get(rel.target.name)
    if sources is None or rows is None:
        raise ValueError(f"add sources 'sources' and {rel.target.name!r} first")
    good, db.errors = remote_rows(df, parent.pk, rel.discover, sources, rows, rel.references[0] if rel.references else None)
    lists = good.groupBy(F.col(f"`{parent.pk}`").alias("_k")).agg(F.array_sort(F.collect_list("row")).alias(name))
    out = df.join(lists, df[parent.pk] == lists["_k"], "left").drop("_k")
    return out.withColumn(name, F.coalesce(name, F.array()))
