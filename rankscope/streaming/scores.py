"""Evaluate score files as they arrive (Q3 over a file-stream source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankscope.operators.metrics import evaluate_methods
from rankscope.sources.csv import SCORE_SCHEMA


def score_file_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 16) -> DataFrame:
    """Streaming DataFrame of score rows (explicit schema, header CSV)."""
    raw = (spark.readStream.schema(SCORE_SCHEMA).option("header", True).option("multiLine", True)
           .option("escape", '"').option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))
    return raw.select(F.col("qid"), F.col("context_id"), F.col("score").cast("double"),
                      F.col("rank").cast("double").cast("int").alias("rank"), F.col("method"),
                      F.col("latency_ms").try_cast("double").alias("latency_ms"))


def evaluate_score_stream(spark: SparkSession, folder: str, candidates: DataFrame, out_path: str,
                          checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of new score files is evaluated against the candidate
    labels and the per-method summary is appended to ``out_path`` (parquet)
    with a batch id.  A method must arrive whole within one file."""
    labels = candidates.select(F.col("qid").cast("string"), F.col("context_id").cast("string"), "label")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        summary = evaluate_methods(batch, labels).withColumn("batch_id", F.lit(batch_id))
        summary.write.mode("append").parquet(out_path)

    w = score_file_stream(spark, folder).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
