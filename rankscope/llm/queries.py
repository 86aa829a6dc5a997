"""The queries over the test tables; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankscope.llm import (angular, bpe, nndescent, packing, quality, ring, secrets, sentences, simhash, suffixes,
                           threshold, warc, wumanber)
from rankscope.llm.common import read_table
from rankscope.llm.sql import centroid_sql, negative_sql, secret_sql, window_sql


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.responses(read_table(spark, sf_dir, "pages"))
    return warc.build_derivatives(records, "id").withColumnRenamed("id", "page_id")


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences.remove_repeated_spans(read_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("sd_spans", lambda s: F.concat_ws(":", s["start"].cast("string"),
                                                                       s["end"].cast("string"))), ",")
    return rows.select("doc_id", F.col("sd_n_sentences").alias("n_sentences"), F.col("sd_n_removed").alias("n_removed"),
                       spans.alias("spans"), F.col("text").alias("kept_text"))


def op3_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return ring.assign_shards(docs, "doc_id", epsilon=0).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != secrets.ADDED[0])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def verdicts(name):
        return F.size(F.filter("spans", lambda s: s["verdict"] == name)).cast("long").alias(f"n_{name}")

    return rows.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
                       F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                       verdicts("example"), verdicts("shared"), verdicts("live"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return comp.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       "component_id")


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_verdicts(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("q_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"),
                       F.col("q_symbols").alias("n_symbols"), F.col("q_dup_lines").alias("n_dup_lines"),
                       F.col("q_repeat_words").alias("n_repeat_words"), "base_failed", "kept", "distance2")


def op9_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("sa_n_bytes").alias("n_bytes"), F.col("sa_n_removed").alias("n_removed"),
                       F.col("sa_n_spans").alias("n_spans"), F.sha2("sa_kept", 256).alias("kept_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, clusters=simhash.text_clusters(docs)).withColumnRenamed("id", "doc_id")


def op11_threshold_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = threshold.cluster_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    digest = F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ","), 256)
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                       digest.alias("centroid_sha256"))


def op12_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return angular.hard_negatives(rows.withColumn("label", label), "vec_id", "embedding", "label",
                                  F.col("vec_id") % 100 == 0)


def op13_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wumanber.decontaminate(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                  read_table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("bd_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    names = F.array_sort(F.transform("bd_items", lambda i: i.cast("string")))
    return rows.select("doc_id", F.col("bd_n_words").alias("n_words"), hits.alias("n_hit"),
                       F.size("bd_items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_sentence_spans": op2_sentence_spans,
    "op3_bounded_ring": op3_bounded_ring,
    "op4_secret_ownership": op4_secret_ownership,
    "op5_nn_descent": op5_nn_descent,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash_bktree": op7_simhash_bktree,
    "op8_robust_outliers": op8_robust_outliers,
    "op9_difference_cover": op9_difference_cover,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_threshold_centroids": op11_threshold_centroids,
    "op12_angular_negatives": op12_angular_negatives,
    "op13_wu_manber": op13_wu_manber,
}

SQL: dict[str, str] = {"op4_secret_ownership": secret_sql(), "op11_threshold_centroids": centroid_sql(),
                       "op12_angular_negatives": negative_sql(), "op13_wu_manber": window_sql()}
