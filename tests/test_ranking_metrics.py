"""Ranking (W1, skew-safe path) and metrics (A1-A5, A13-A17) on hand-made groups."""

import math

import pytest
from pyspark.sql import functions as F

from rankscope.operators.metrics import (classification_metrics, evaluate_methods, listwise_loss,
                                         per_query_metrics, pointwise_loss)
from rankscope.operators.ranking import _window_number, number_within, range_number, rank_scores, score_order


def test_rank_scores_ties_nan_null(spark):
    rows = [("q1", "c3", 0.5), ("q1", "c1", 0.5), ("q1", "c2", float("nan")), ("q1", "c0", None), ("q1", "c9", 0.9),
            ("q2", "c1", 1.0)]
    df = spark.createDataFrame(rows, "qid string, context_id string, score double")
    got = {(r.qid, r.context_id): r.rank for r in rank_scores(df, "m").collect()}
    assert got[("q1", "c9")] == 1 and got[("q1", "c1")] == 2 and got[("q1", "c3")] == 3
    assert {got[("q1", "c0")], got[("q1", "c2")]} == {4, 5}  # NaN and null sort last
    assert got[("q2", "c1")] == 1


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_range_path_equals_window(spark, parts):
    df = spark.range(0, 3000).select((F.col("id") % 4).alias("g"), (F.rand(7) * 40).cast("int").alias("s"), "id")
    order = [F.col("s").desc(), F.col("id").asc()]
    a = range_number(df, ["g"], order, "rk", partitions=parts)
    b = _window_number(df, ["g"], order, "rk")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    hybrid = number_within(df, ["g"], order, "rk", hot_rows=500)
    assert hybrid.exceptAll(b).count() == 0


def _toy_eval(spark):
    cand = spark.createDataFrame([("a", "1", 1), ("a", "2", 0), ("a", "3", 0), ("b", "1", 0), ("b", "2", 1),
                                  ("b", "3", 1), ("c", "1", 0), ("c", "2", 0)], "qid string, context_id string, label int")
    scores = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.5), ("a", "3", 0.1), ("b", "1", 0.9), ("b", "2", 0.8),
                                    ("b", "3", 0.7), ("c", "1", 0.3), ("c", "2", 0.2)],
                                   "qid string, context_id string, score double")
    return cand, rank_scores(scores.withColumn("latency_ms", F.lit(2.0)), "m")


def test_per_query_metrics_by_hand(spark):
    cand, scores = _toy_eval(spark)
    pq = {r.qid: r for r in per_query_metrics(scores, cand).collect()}
    assert (pq["a"].hit_1, pq["a"].rr, pq["a"].ndcg_5) == (1.0, 1.0, 1.0)
    assert (pq["b"].hit_1, pq["b"].hit_3, pq["b"].rr) == (0.0, 1.0, 0.5)
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    idcg = 1 + 1 / math.log2(3)
    assert pq["b"].ndcg_5 == pytest.approx(dcg / idcg)
    assert (pq["c"].hit_5, pq["c"].rr, pq["c"].ndcg_5) == (0.0, 0.0, 0.0)
    s = evaluate_methods(scores, cand).first()
    assert s.num_eval_qids == 3 and s.precision_at_1 == round(1 / 3, 4) and s.avg_latency_ms == 2.0
    # invariants from the published tables
    assert s.precision_at_1 <= s.precision_at_3 <= s.precision_at_5 and s.precision_at_1 <= s.mrr <= 1


def test_classification_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, pred int")
    r = classification_metrics(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 0, 1, 0) and r.precision == 0.0 and r.f1 == 0.0
    assert r.accuracy == pytest.approx(2 / 3)


def test_losses(spark):
    df = spark.createDataFrame([("a", "1", 1, 2.0), ("a", "2", 0, 1.0), ("a", "3", 0, 0.0),
                                ("b", "1", 0, 3.0), ("b", "2", 1, 3.0)], "qid string, context_id string, label int, score double")
    r = listwise_loss(df).first()
    ce_a = -2.0 + math.log(math.exp(2) + math.exp(1) + 1)
    ce_b = -3.0 + math.log(2 * math.exp(3))
    assert r.loss == pytest.approx((ce_a + ce_b) / 2) and r.val_p1 == 0.5 and r.val_mrr == pytest.approx(0.75)
    p = pointwise_loss(df, pos_weight=9.0).first()
    sp = lambda x: math.log1p(math.exp(x))
    exp = (9 * sp(-2.0) + sp(1.0) + sp(0.0) + sp(3.0) + 9 * sp(-3.0)) / 5
    assert p.loss == pytest.approx(exp)


def test_score_order_column(spark):
    assert len(score_order()) == 2
