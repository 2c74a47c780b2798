"""Versioned tables: every commit writes a new folder and then an empty file named after it.

The greatest such number is the current version, so a commit becomes visible by one atomic
creation and a crash in between leaves the version before. Readers see a whole version or the one before. One writer at a time is assumed. Files are
reached through Hadoop's file system, so any storage that Spark can reach will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self, table: str) -> int:
        """Number of the current version; 0 when there is none."""
        marks = self._fs_path(f"{self.folder}/{table}/versions")
        if not self._fs.exists(marks):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(marks)), default=0)

    def exists(self, table: str) -> bool:
        return self.version(table) > 0

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}/v{version or self.version(table)}")

    def commit(self, table: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """Write the next version. ``rows`` may be made from the current one."""
        new = self.version(table) + 1
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.folder}/{table}/v{new}")
        self._point(table, new)
        return new

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to the current version, for logs that only grow."""
        if not self.exists(table):
            self.commit(table, rows)
        else:
            rows.write.mode("append").parquet(f"{self.folder}/{table}/v{self.version(table)}")

    def size(self) -> int:
        """Bytes of all versions; 0 for a missing folder."""
        path = self._fs_path(self.folder)
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def _point(self, table: str, version: int) -> None:
        """Make a version the current one; an error when it already is."""
        self._fs.create(self._fs_path(f"{self.folder}/{table}/versions/{version}"), False).close()
