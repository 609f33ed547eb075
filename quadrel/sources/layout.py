"""Table layouts on storage: partition folders after the identifier template. The folder that a session shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.operators.identity import DATE_PARTS, TIME_COLUMNS, names, pruning_filter
from quadrel.schema import Table


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a temporary one is set for a local master; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrel-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the file system drops it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partition_columns(t: Table) -> list[str]:
    """Template variables that place a row's document: all but the id."""
    return [n for n in names(t.template) if n not in ("id", t.pk, "index")]


def write_table(df: DataFrame, t: Table, path: str, format: str = "parquet", mode: str = "append") -> None:
    """Appends rows to the layout; date parts come from the table's time column. Rows of a folder go to one task set."""
    by = partition_columns(t)
    time = next((c for c in TIME_COLUMNS if c in df.columns), None)
    for n in by:
        if n in DATE_PARTS and n not in df.columns:
            df = df.withColumn(n, F.date_format(time, DATE_PARTS[n]))
    writer = (df.repartition(*by, F.pmod(F.xxhash64(t.pk), F.lit(8))) if by else df).write.mode(mode).format(format)
    (writer.partitionBy(*by) if by else writer).save(path)


def read_table(spark: SparkSession, t: Table, path: str, format: str = "parquet", **equal: object) -> DataFrame:
    """The table's rows; equalities on template variables read only their folders."""
    df = spark.read.format(format).load(path)
    for n, v in equal.items():
        df = df.filter(F.col(n) == v)
    assert set(pruning_filter(t, equal)) <= set(df.columns)
    return df.select(*t.columns)


def list_container(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, size of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
