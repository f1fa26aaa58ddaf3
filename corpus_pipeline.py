"""Corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing.

``STAGES`` are (name, function) pairs.  A function takes (spark, docs, sf_dir)
and returns the DataFrame that is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of ``documents``; the
last returns one row per packed piece.  Stages read texts and ids, so extra
columns pass through untouched, and an empty table stays empty to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import fit_packing, host_rules, mixing, near_dup, toxicity
from chronoweave.llm.common import written
from chronoweave.llm.queries import MIX_SEED, TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and whose host passes (operator 7)."""
    return host_rules.keep(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.3, by a model of the labelled ones among them (operator 1)."""
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.75 (operator 5)."""
    return near_dup.keep(docs, k=5, part=75, whole=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards source shares of rows ** 0.5, shuffled (operator 10)."""
    return mixing.mix(docs, power=0.5, seed=MIX_SEED, copy_col=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed into sequences of at most 1024 tokens (operator 2)."""
    return fit_packing.pack(docs, TOKENIZER, size=1024, end_id=2)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic_documents), ("near_duplicates", near_duplicates),
          ("source_mix", source_mix), ("packing", packing)]
ORACLE_SQL = None  # the toxicity model is trained, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; returns the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
