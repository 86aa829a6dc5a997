"""Score store (S8, J1): candidates and scores as tables laid out for evaluation.

Scores are partitioned by method and bucketed by (qid, context_id)'s qid;
candidates are bucketed alike.  Joins by qid, ranking windows and per-question
aggregates over the store then need no exchange on qid, and a read of some
methods leaves the files of the others alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES, CANDIDATES = "scores", "candidates"


def write_store(scores: DataFrame, candidates: DataFrame, name: str, buckets: int = 200) -> None:
    """Saves both as tables ``<name>_scores`` and ``<name>_candidates`` of the session's warehouse, replacing old ones.

    Rows are dealt by qid first, so that each bucket is one sorted file.
    """
    if buckets < 1:
        raise ValueError("at least one bucket")
    for table, rows, partitions in ((SCORES, scores, ["method"]), (CANDIDATES, candidates, [])):
        writer = (rows.repartition(buckets, "qid").write.mode("overwrite").format("parquet")
                  .bucketBy(buckets, "qid").sortBy("qid"))
        (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(f"{name}_{table}")


def read_scores(spark: SparkSession, name: str, methods: list[str] | None = None) -> DataFrame:
    """The stored scores, of some methods only if given."""
    rows = spark.table(f"{name}_{SCORES}")
    return rows if methods is None else rows.where(F.col("method").isin(methods))


def read_candidates(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(f"{name}_{CANDIDATES}")
