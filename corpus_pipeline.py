"""From raw documents to packed sequences: quality rules, exact dedup, near dedup, PII, packing.

Every stage reads whole tables and whole texts of any length, takes null in any column, repeated rows and columns of any
names but those that begin with __, and gives an empty table for an empty one. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm import nearjoin, packing, pii, recipes, rules
from quadrel.llm.base import table, written
from quadrel.llm.queries import BYTE_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the rules reject go, those with null or empty text too. The labelled rows are those of the labels table.

    Repeated rows stay or go together. A score on the threshold stays.
    """
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts (null counts as empty) the largest doc_id stays, of its repeated rows one; a null doc_id is the smallest."""
    return recipes.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of documents that links connect the smallest doc_id stays, nulls last, of its repeated rows one.

    Texts without words (null and empty ones) are one class that links to nothing.
    """
    return nearjoin.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: spans are replaced by their kind, overlapping ones as one; n_chars, where there is one, follows the text.

    All rows stay, repeated ones too; null text stays null.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the pieces of all documents and their places in sequences.

    Null and empty texts are one piece of the end id; repeated rows are packed each; ties in length go by doc_id.
    """
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("quality_rules", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", personal_data), ("packing", packed),
]

#: Isolation forest, near classes, boosted trees and packing are not SQL: tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
