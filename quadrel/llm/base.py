"""What the operators share: the shared scratch folder, written intermediate tables, reading inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.sources.layout import scratch, shared_dir, written

__all__ = ["ascii_lower", "scratch", "shared_dir", "splittable", "table", "whole_text", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def splittable(df: DataFrame, *keys: str) -> DataFrame:
    """df, an aggregate by the keys that it is about to be joined by, dealt out by a hash of them.

    The join then has a plain shuffle on either side, and adaptive execution splits the other side at a hot key.
    Right above an aggregate by the join's own keys it can't.
    """
    return df.repartition(F.xxhash64(*keys))


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII takes the byte-wise lower(), the rest a character map."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
