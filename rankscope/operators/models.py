"""Lightweight rerankers on MLlib (M4-M6): logistic regression and random forest.

Balanced class weights n / (2 * n_class); features standardised with the
training mean and population deviation (zero deviation -> 1).  For logistic
regression, regParam = 1/n with standardization off reproduces the
summed-loss + 1/2 ||w||^2 objective.
"""

from __future__ import annotations

import time

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankscope.operators.metrics import classification_metrics
from rankscope.operators.ranking import rank_scores
from rankscope.operators.sampling import split_by_qid
from rankscope.operators.scoring import FEATURE_COLUMNS, build_features
from rankscope.session import DEFAULT_FIT_ROWS, conf_int, dealt_evenly, materialize


def train_lightweight(cand: DataFrame, kind: str = "logreg", test_size: float = 0.25, seed: int = 42,
                      score_subset: str = "test", method: str = "lightweight_ml") -> tuple[DataFrame, DataFrame]:
    """M6: split by qid, fit on train, classification metrics on test, then
    P(positive) for ``score_subset`` rows (all | test | train) ranked with W1."""
    if kind not in ("logreg", "rf"):
        raise ValueError(f"unknown model kind {kind}")
    feats = materialize(build_features(cand))  # the texts are read once and go no further
    split = materialize(split_by_qid(feats, test_size, seed))
    most = conf_int(feats.sparkSession, "rankscope.fitRows", DEFAULT_FIT_ROWS)
    feats = materialize(dealt_evenly(feats.join(split, "qid"), feats.count(), most, "qid"))
    train = feats.where(F.col("split") == "train")
    stats = train.agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.col("label").cast("long")).alias("npos"),
                      *[F.avg(c).alias(f"m_{c}") for c in FEATURE_COLUMNS],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURE_COLUMNS]).first()
    n, npos = int(stats["n"]), int(stats["npos"] or 0)
    if n == 0 or npos in (0, n):
        raise ValueError("training split needs both classes")
    w_pos, w_neg = n / (2.0 * npos), n / (2.0 * (n - npos))
    scaled = feats.select(
        "qid", "context_id", "label", "split",
        F.when(F.col("label") == 1, F.lit(w_pos)).otherwise(F.lit(w_neg)).alias("w"),
        *[((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)).alias(c) for c in FEATURE_COLUMNS])
    data = VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features").transform(scaled)
    if kind == "logreg":
        est = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=1.0 / n,
                                 elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10)
    else:
        est = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="w", numTrees=200,
                                     maxDepth=6, seed=seed)
    model = est.fit(data.where(F.col("split") == "train").withColumn("label", F.col("label").cast("double")))
    out = model.transform(data).withColumn("prob", vector_to_array("probability")[1])
    test = out.where(F.col("split") == "test").select("label", F.col("prediction").cast("int").alias("pred"))
    metrics = classification_metrics(test).select(
        F.lit(kind).alias("model"),
        F.lit(split.where("split = 'train'").count()).alias("num_train_qids"),
        F.lit(split.where("split = 'test'").count()).alias("num_test_qids"), "*",
        F.lit(",".join(FEATURE_COLUMNS)).alias("features"))
    subset = out if score_subset == "all" else out.where(F.col("split") == score_subset)
    t0 = time.perf_counter()
    scored = materialize(subset.select("qid", "context_id", F.col("prob").alias("score")))
    rows = max(scored.count(), 1)
    per_pair_ms = (time.perf_counter() - t0) * 1000.0 / rows
    return rank_scores(scored.withColumn("latency_ms", F.lit(per_pair_ms)), method), metrics
