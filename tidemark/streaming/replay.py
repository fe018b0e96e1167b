"""Streams over stored tables: a table read as a stream, run to its end, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir; without that setting, on a local master alone, in a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder, as a stream, in batches of that many files.

    The name is made a pattern, which a file source takes for a single file too."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def run_to_end(stream: DataFrame, each_batch: Callable[[DataFrame, int], None] | None = None, folder: str | None = None) -> DataFrame | None:
    """What a stream gives over all that its source holds now, by way of Parquet files in the shared folder.

    With each_batch, batches go to that function instead, and nothing is returned."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        if each_batch is None:
            writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start().awaitTermination()
        else:
            writer.foreachBatch(each_batch).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out") if each_batch is None else None
