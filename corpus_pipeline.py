"""Cleaning pipeline over ``documents``: quality, near-dedup, substring dedup, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``run`` writes each result as Parquet in the shared folder of
``spark.checkpoint.dir`` and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankscope.llm import packing, quality, secrets, sentences, simhash
from rankscope.llm.common import read_table
from rankscope.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are multivariate outliers go."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one_per_component(docs)


def _with_length(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated runs are cut from all but the first document; n_chars follows the text."""
    return _with_length(sentences.remove_repeated_spans(docs), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values that are no widely copied examples are masked; n_chars follows the text."""
    return _with_length(secrets.mask_live(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in bins without two pieces of a source or duplicate cluster.

    doc_id and text_key lead from a piece to its text in the stage before.
    """
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("substring_dedup", substring_dedup),
          ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Iterated estimates, fingerprints and packing have no SQL form; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
