"""A corpus pipeline over the documents table: each stage calls one operator of tidemark.llm on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import default_tokenizer_path
from tidemark.llm.common import end_stage, materialise, stage, table
from tidemark.llm.packing import pack
from tidemark.llm.pii import pseudonymise
from tidemark.llm.quality_rules import judge
from tidemark.llm.queries import DEMO_KEY, bad_quality
from tidemark.llm.simhash import one_of_each
from tidemark.llm.suffix_dedup import remove_repeats


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base filter or that a learned rule rejects go."""
    return judge(docs, bad_quality(spark, sf_dir), keep_rows=True).where("kept").select("row.*")


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, which links of five-word shingles at a similarity of 0.8 join, the document with the
    smallest id stays."""
    return one_of_each(docs, shingle=5, similarity=0.8)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a 100-byte string covers which also starts earlier go."""
    return _counted(remove_repeats(docs, length=100, keep_columns=True))


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pseudonymise(docs, DEMO_KEY, count_col=None))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_tokenizer_path(), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", repeated_passages),
    ("pii", personal_data),
    ("packing", packing),
]

#: The stages learn, link and pack, which SQL can't express; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, made in STAGES:
        docs = materialise(made(spark, docs, sf_dir), name, lasting=True)
    end_stage(spark)
    return docs
