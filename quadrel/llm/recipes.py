"""Operator 3, exact dedup: content-defined chunk recipes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.llm.base import ascii_lower, splittable, whole_text, written

#: A chunk ends behind a vowel and white space once it has MIN characters, at MAX at the latest.
MIN, MAX = 256, 2048


def chunks(text: Column, least: int = MIN, most: int = MAX) -> Column:
    """The text cut at places that its own content sets; the chunks joined are the text again."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?(?<=[aeiou][ \\n])|.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, recipe (short chunk identifiers in order), proofs (their SHA-256), text_sha256."""
    norm = ascii_lower(whole_text(text_col))
    cut = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("chunk", chunks(F.col("norm")))
    return cut.select(
        "doc_id",
        F.transform("chunk", lambda c: F.xxhash64(c)).alias("recipe"),
        F.transform("chunk", lambda c: F.sha2(c, 256)).alias("proofs"),
        F.sha2("norm", 256).alias("text_sha256"),
    )


def verified_keys(found: DataFrame) -> DataFrame:
    """found with `key`, which two documents share if and only if their lists of chunks are the same.

    Chunks are deduplicated by short identifier; one that stands for two SHA-256 values (compared in full, as
    five numbers) is ambiguous, and the recipes that hold it are compared by their SHA-256 lists instead.
    """
    flat = found.select(F.explode(F.arrays_zip("recipe", "proofs")).alias("c")).select(F.col("c.recipe").alias("short"), F.col("c.proofs").alias("proof"))
    parts = range(5)
    part = lambda k: F.conv(F.substring("proof", 15 * k + 1, 15), 16, 10).cast("long").alias(f"p{k}")
    ids = flat.select("short", *map(part, parts)).groupBy("short").agg(*(f(f"p{k}").alias(f"{f.__name__}{k}") for k in parts for f in (F.min, F.max)))
    ambiguous = written(ids.filter(" or ".join(f"min{k} <> max{k}" for k in parts)).select("short"), "ambiguous")
    if ambiguous.isEmpty():
        return found.withColumn("key", F.struct("recipe", F.lit(None).cast("array<string>").alias("proofs"))).drop("recipe", "proofs")
    listed = found.withColumn("code", F.xxhash64("recipe"))
    hit = listed.select("code", F.explode("recipe").alias("short")).join(ambiguous, "short", "left_semi").select("code").distinct()
    keyed = listed.join(hit.withColumn("unsure", F.lit(True)), "code", "left")
    return keyed.withColumn("key", F.struct("recipe", F.when(F.col("unsure"), F.col("proofs")).alias("proofs"))).drop("code", "unsure", "recipe", "proofs")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its group of equal texts (equal after lower-casing A-Z).

    Columns: doc_id, keep_id (largest doc_id of the group), group_size (rows), kept, text_sha256.
    Null text counts as empty, so null and empty texts form one group. A null doc_id sorts below all
    others. Repeated rows of one doc_id count in group_size and are all kept or all dropped. A text of any
    length is a list of chunks of at most MAX characters. Extra columns of docs, whatever their names, are
    ignored; an empty table gives no rows.
    """
    keyed = verified_keys(written(recipes(docs, id_col, text_col), "recipes"))
    groups = keyed.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    rows = keyed.join(splittable(groups, "key"), "key", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, all columns; of repeated rows of a doc_id with one text, one.

    Null and empty texts form one group, null doc_ids sort below others; an empty table gives no rows. Columns
    of any names but __id, __sha and __n are passed on.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("__id")
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(name("doc_id"), F.col("text_sha256").alias("__sha")).distinct()
    marked = docs.select("*", name(id_col), F.sha2(ascii_lower(whole_text(text_col)), 256).alias("__sha"))
    one = Window.partitionBy("__id", "__sha").orderBy("__id")  # dealt out as for the join
    found = marked.join(kept, ["__id", "__sha"], "left_semi").withColumn("__n", F.row_number().over(one))
    return found.filter("__n = 1").select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
