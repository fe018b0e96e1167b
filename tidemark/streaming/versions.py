"""Streams joined to a table that is refreshed while they run: versions in Parquet, swapped between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """A small-to-large lookup table kept as whole versions under one shared folder; the last complete one is current.

    A version is a folder of Parquet files and is complete once its writer has committed. Readers hold on to the number they
    began with, so a refresh never changes a batch that is under way."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self._conf)

    def _exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def current(self) -> int:
        """The number of the last complete version; 0 if there is none."""
        path, fs = self._path("versions")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit() and self._exists(f"versions/{n}/_SUCCESS")), default=0)

    def publish(self, df: DataFrame) -> int:
        """Write df as the next version; it is current from its commit on. One writer at a time."""
        n = self.current() + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/versions/{n}")
        return n

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/versions/{version}") if version else self.spark.createDataFrame([], self.schema)

    def pinned(self, epoch: int) -> int:
        """The version that was current when an epoch was first asked about: the same when the epoch is run again."""
        if not self._exists(f"pins/{epoch}/_SUCCESS"):
            self.spark.range(1).select(F.lit(self.current()).alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pins/{epoch}")
        return self.spark.read.parquet(f"{self.folder}/pins/{epoch}").first()["version"]

    def retire(self, before: int) -> None:
        """Remove versions below a number, once no batch can ask for them."""
        for n in range(1, min(before, self.current())):
            path, fs = self._path(f"versions/{n}")
            fs.delete(path, True)


def enriched(table: VersionedTable, key: str, path_of: Callable[[int], str], history: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch is joined by key to the version that was current when it began, and written.

    history, if given, makes the rows of keys that the table doesn't hold yet (from their past): the first batch that brings
    such keys publishes a version with them, and uses it. Only new keys are looked up, whatever the batch's size. A batch that
    is run again pins the same version and overwrites its own files. Rows without a match keep nulls."""

    def each(batch: DataFrame, epoch: int) -> None:
        version = table.pinned(epoch)
        if history is not None:
            known = table.read(version)
            missing = batch.where(F.col(key).isNotNull()).select(key).distinct().join(known.select(key), key, "left_anti")
            if not missing.isEmpty():
                version = table.publish(known.unionByName(history(missing).select(known.columns)))
        batch.join(table.read(version), key, "left").withColumn("version", F.lit(version)).write.mode("overwrite").parquet(path_of(epoch))

    return each
