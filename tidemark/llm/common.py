"""Helpers that the operators of this subpackage share: reading tables, scratch tables on shared storage, partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_scratch: list[str] = []
#: The scratch tables of the run that is under way, if any.
_run: ContextVar[list[str] | None] = ContextVar("scratch_run", default=None)
#: Those of the stage that was called last.
_left: ContextVar[list[str] | None] = ContextVar("scratch_left", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a session on a local master without that setting gets a temporary folder of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _local_scratch[0]


def materialise(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage, survives lost executors, and keeps what several later steps read from being computed twice.
    The files stay until the session's owner removes them; those written within a scratch_run, unless they are lasting,
    go when it ends."""
    path = f"{scratch_dir(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not lasting and (mine := _run.get()) is not None:
        mine.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """A run that owns the scratch tables written within it, and removes them when it ends: by then its results must have
    been written or collected. Tables of other runs, and those written outside of any, stay."""
    mine: list[str] = []
    token = _run.set(mine)
    try:
        yield
    finally:
        _run.reset(token)
        _remove(spark, mine)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A pipeline's stage f(spark, docs, sf_dir), whose scratch tables go when the next stage begins.

    What a stage returns is read from its scratch tables, so they must outlive the call. The next stage begins, in the same
    thread, when that result has been written and read again, as a pipeline's stages promise each other; tables that its docs
    still read are kept until a later one. Other threads' tables, and those written outside of stages, stay."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.get() or []
        files = docs.inputFiles() if left else []
        mine = [path for path in left if any(f"/{path.rpartition('/')[2]}/" in file for file in files)]
        _remove(spark, [path for path in left if path not in mine])
        token = _run.set(mine)
        try:
            return f(spark, docs, sf_dir)
        finally:
            _run.reset(token)
            _left.set(mine)

    return run


def end_stage(spark: SparkSession) -> None:
    """Remove the scratch tables of this thread's last stage, whose result has been written."""
    _remove(spark, _left.get() or [])
    _left.set(None)


def id_text(id_col: str) -> Column:
    """An id as text, for Python workers: pandas would make nullable whole numbers doubles, which lose large ones."""
    return F.col(id_col).cast("string").alias("id")


def typed_ids(df: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """df with its ids of id_text made what they are in docs, under their name there."""
    return df.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def text_partitions(docs: DataFrame, text_col: str, bytes_each: int) -> int:
    """How many partitions a shuffle of all texts needs, so that each holds about bytes_each; never fewer than four times
    the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(4 * shuffle_partitions(docs.sparkSession), -(-total // bytes_each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
