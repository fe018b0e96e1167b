"""Scans, upserts and append sinks over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, time: str, from_ms: int, to_ms: int, symbol=None) -> DataFrame:
    """Rows of a closed range of time, of one symbol or all; both reach the files as pushed filters."""
    df = spark.read.parquet(path).where(F.col(time).between(from_ms, to_ms))
    return df if symbol is None else df.where(F.col("symbol") == symbol)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in the order. Rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """current with the last change of each key in place of its row, and rows of new keys added."""
    new = last_wins(changes, keys, order).select(current.columns)
    return current.join(new.select(keys), keys, "left_anti").unionByName(new)


def insert_ignore(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key current doesn't hold yet, one of each key."""
    return rows.dropDuplicates(keys).join(current.select(keys), keys, "left_anti")


def replace_flags(df: DataFrame, key: str, flagged: DataFrame, name: str) -> DataFrame:
    """df with a flag that is true exactly for the keys in flagged."""
    return df.drop(name).join(flagged.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def archive(df: DataFrame, path: str, time: str, cutoff_ms: int, keys: list[str]) -> DataFrame:
    """Write rows older than the cutoff into the archive, partitioned by UTC date, and return those that stay.

    Dates that the archive holds already are merged by key, later rows winning. The archive is read again and counted
    before anything is given up; a shortfall raises an error."""
    spark = df.sparkSession
    old = df.where(F.col(time) < cutoff_ms).withColumn("date", F.to_date(F.timestamp_millis(F.col(time))))
    n = old.select(keys).distinct().count()
    old.repartition("date").withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))).where("__n = 1").drop("__n").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    kept = spark.read.parquet(path).join(old.select(keys).distinct(), keys, "left_semi").count()
    if kept < n:
        raise RuntimeError(f"the archive holds {kept} of {n} rows")
    return df.where(F.col(time) >= cutoff_ms)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, name) of a pipe-separated symbol directory: test issues, funds, footers and odd symbols are left out."""
    raw = spark.read.option("sep", "|").option("header", True).csv(path)
    first, second = raw.columns[:2]
    yes = lambda c: F.coalesce(F.col(f"`{c}`") == "Y", F.lit(False)) if c in raw.columns else F.lit(False)
    good = raw.where(F.col(f"`{first}`").rlike("^[A-Z0-9][A-Z0-9.-]*$") & ~yes("Test Issue") & ~yes("ETF"))
    return good.select(F.col(f"`{first}`").alias("symbol"), F.col(f"`{second}`").alias("name")).distinct()


def log_events(spark: SparkSession, path: str) -> DataFrame:
    """(ts, event, fields) of key=value log lines; compressed files are read as they are."""
    lines = spark.read.text(path)
    pairs = F.regexp_extract_all("value", F.lit(r"(\w+)=(\S+)"), F.lit(0))
    ts, event = (F.regexp_extract("value", r"^(\S+ \S+) (\S+)", k) for k in (1, 2))
    return lines.select(ts.alias("ts"), event.alias("event"), F.map_from_entries(F.transform(F.array_distinct(pairs), lambda p: F.struct(F.split(p, "=", 2)[0], F.split(p, "=", 2)[1]))).alias("fields")).where("ts <> ''")
