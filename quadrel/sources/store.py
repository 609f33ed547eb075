"""Tables that last: a folder of versions on storage, of which the last finished one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.schema import Table
from quadrel.sources.layout import partition_columns, write_table


class Store:
    """path/version=N/: added rows go to the newest version, changes write the next one; a reader sees one or the other.

    A version counts once its job has finished (Spark's _SUCCESS), so a job that fails leaves the old one.
    """

    def __init__(self, spark: SparkSession, t: Table, path: str, format: str = "parquet") -> None:
        self.spark, self.table, self.path, self.format = spark, t, path.rstrip("/"), format

    def _files(self) -> tuple[object, object]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Numbers of the finished versions, rising."""
        files, at = self._files()
        if not files.exists(at(self.path)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at(self.path))]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and files.exists(at(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an older one; an empty table before the first."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self.table.struct_type())
        at = f"{self.path}/version={found[-1] if version is None else version}"
        fields = self.table.struct_type()
        return self.spark.read.format(self.format).load(at).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields))

    def append(self, rows: DataFrame) -> None:
        found = self.versions()
        write_table(rows, self.table, f"{self.path}/version={found[-1] if found else 1}", self.format)

    def replace(self, rows: DataFrame) -> None:
        """The next version; what it was made from stays readable."""
        found = self.versions()
        write_table(rows, self.table, f"{self.path}/version={found[-1] + 1 if found else 1}", self.format, "overwrite")

    def vacuum(self, keep: int = 1) -> int:
        """Drops all but the newest versions; returns how many."""
        files, at = self._files()
        old = self.versions()[:-keep] if keep else []
        for n in old:
            files.delete(at(f"{self.path}/version={n}"), True)
        return len(old)

    def partitions(self) -> list[str]:
        return partition_columns(self.table)
