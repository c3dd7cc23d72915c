"""A training corpus from raw documents: language ID, exact dedup, MinHash near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents; the last returns each document as often as the mix takes it, with the
number of the copy.

Edge cases: null texts and texts without letters go in the first stage; rows without identifier, and rows that share one, are told
apart and decided each by itself; very long texts are read whole; equal rows are copies, of which one stays; ties go to the
smallest identifier; tables without rows give no rows; further columns go through untouched, whatever their names (but `copy`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import decontaminate, exact_dedup, language_id, mixing, near_dedup
from twinloom.llm.common import materialise, row_keys


def _kept(docs: DataFrame, decide: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that `decide` keeps, of rows that an identifier tells apart: no row goes because another of its doc_id does."""
    rows, node = row_keys(docs, "doc_id")
    gone = decide(rows, node).filter("not kept").select(F.col(node).alias(f"_gone_{node}"))
    return rows.join(gone, rows[node] == F.col(f"_gone_{node}"), "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; no score is too low, so only texts without letters go."""
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _kept(docs, exact_dedup.dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return _kept(docs, near_dedup.near_groups)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents by their sources' weights, with the number of the copy."""
    return mixing.mix(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("mixing", mixed)]

#: Language ID, near-dedup and decontamination are not SQL; the tests hold the pipeline against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
