"""Ranking and classification metrics.

Per-qid metrics are built only from skew-safe pieces: top-k rows per group
(``row_number() <= k`` -> WindowGroupLimit, limited before the shuffle) and
plain aggregates with map-side combine.  No operator here buffers a whole
group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankscope.functions.numeric import round_metric, softplus, to_double_or
from rankscope.operators.ranking import dealt_by, number_within, score_order, top_k
from rankscope.session import spread

SUMMARY_COLUMNS = ["method", "num_eval_qids", "precision_at_1", "precision_at_3",
                   "precision_at_5", "mrr", "ndcg_at_5", "avg_latency_ms"]


def _gain_sum(label: Column, pos: Column, k: int) -> Column:
    return F.sum(F.when(pos <= k, label.cast("double") / F.log2(pos + F.lit(1.0))))


def _is_empty(joined: DataFrame) -> bool:
    """``isEmpty`` of rows by qid; those of a few qids are looked for first, as a filter by qid goes down to the scans."""
    few = F.pmod(F.xxhash64("qid"), F.lit(64)) == 0
    return joined.where(few).isEmpty() and joined.isEmpty()


def per_query_metrics(scores: DataFrame, candidates: DataFrame, ks: Sequence[int] = (1, 3, 5),
                      ndcg_k: int = 5, dealt: bool = False, hot_rows: int | None = None) -> DataFrame:
    """A1-A3 per (method, qid) on scores joined to candidate labels.

    hit@k and DCG use the position among joined rows sorted by rank (K2);
    reciprocal rank uses the stored rank value of the best positive.
    ``dealt``: both lie by qid, from tables bucketed by it (sources.store) or
    from one exchange, and no group is hot.
    """
    s = scores.select("method", "qid", "context_id", F.col("rank").cast("double").alias("rank"))
    lab = candidates.select("qid", "context_id", F.col("label"))
    keys = ["method", "qid"]
    joined = s.join(lab, ["qid", "context_id"])
    if _is_empty(joined):
        raise ValueError("no score row has a candidate with its qid and context_id")
    j = dealt_by(joined, keys, s, dealt, hot_rows)  # read by three branches below
    kmax = max(max(ks), ndcg_k)
    by_rank = top_k(j, keys, [F.col("rank").asc_nulls_last(), F.col("context_id").asc()], kmax)
    pos, label = F.col("pos"), F.col("label")
    head = by_rank.groupBy(*keys).agg(
        *[F.when(F.sum(F.when(pos <= k, label)) > 0, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in ks],
        F.coalesce(_gain_sum(label, pos, ndcg_k), F.lit(0.0)).alias("dcg"))
    ideal = (top_k(j, keys, [F.col("label").desc_nulls_last(), F.col("context_id").asc()], ndcg_k, "ipos")
             .groupBy(*keys).agg(F.coalesce(_gain_sum(label, F.col("ipos"), ndcg_k), F.lit(0.0)).alias("idcg")))
    full = j.groupBy(*keys).agg(F.min(F.when(label == 1, F.col("rank"))).alias("best_rank"))
    out = (full.join(head, keys).join(ideal, keys)
           .withColumn("rr", F.coalesce(F.lit(1.0) / F.col("best_rank"), F.lit(0.0)))
           .withColumn(f"ndcg_{ndcg_k}", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)))
    return out.select(*keys, *[f"hit_{k}" for k in ks], "rr", f"ndcg_{ndcg_k}")


def evaluate_methods(scores: DataFrame, candidates: DataFrame, places: int | None = 4, dealt: bool = False) -> DataFrame:
    """A4/A5 + P12: one summary row per method, all methods in one plan (Q3)."""
    pq = per_query_metrics(scores, candidates, dealt=dealt)
    summ = pq.groupBy("method").agg(
        F.count(F.lit(1)).alias("num_eval_qids"),
        F.avg("hit_1").alias("precision_at_1"), F.avg("hit_3").alias("precision_at_3"),
        F.avg("hit_5").alias("precision_at_5"), F.avg("rr").alias("mrr"),
        F.avg("ndcg_5").alias("ndcg_at_5"))
    lat = scores.groupBy("method").agg(F.avg(to_double_or("latency_ms")).alias("avg_latency_ms"))
    out = summ.join(lat, "method")
    if places is not None:
        for c in SUMMARY_COLUMNS[2:]:
            out = out.withColumn(c, round_metric(c, places))
    return out.select(*SUMMARY_COLUMNS)


def ranking_metrics_from_scores(df: DataFrame, group: Sequence[str] = ("method",),
                                hot_rows: int | None = None) -> DataFrame:
    """Rank by (score desc, context_id), then hit@1/3/5 and MRR from the
    best positive rank per qid (0 when a qid has no positive)."""
    keys = [*group, "qid"]
    ranked = number_within(df, keys, score_order(), "rank", hot_rows)
    per_q = ranked.groupBy(*keys).agg(F.min(F.when(F.col("label").cast("int") == 1, F.col("rank"))).alias("pr"))
    pr = F.col("pr")
    hit = lambda k: F.avg(F.when(pr <= k, 1.0).otherwise(0.0))
    return per_q.groupBy(*group).agg(
        hit(1).alias("val_p1"), hit(3).alias("val_p3"), hit(5).alias("val_p5"),
        F.avg(F.coalesce(F.lit(1.0) / pr, F.lit(0.0))).alias("val_mrr"))


def threshold_labels(prob: Column | str, cut: float = 0.5) -> Column:
    """P >= cut -> 1 else 0."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (p >= cut).cast("int")


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                           group: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on zero division) and the
    confusion counts tn, fp, fn, tp -- four conditional sums, one pass."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    cnt = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    agg = df.groupBy(*group).agg(cnt((y == 0) & (p == 0)).alias("tn"), cnt((y == 0) & (p == 1)).alias("fp"),
                                 cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 1) & (p == 1)).alias("tp"))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return agg.select(
        *group,
        F.when(tn + fp + fn + tp > 0, (tp + tn) / (tn + fp + fn + tp)).otherwise(0.0).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"),
        "tn", "fp", "fn", "tp")


def pointwise_loss(df: DataFrame, label: str = "label", logit: str = "score", pos_weight: float = 9.0,
                   group: Sequence[str] = ()) -> DataFrame:
    """Mean weighted logistic loss  w*y*softplus(-s) + (1-y)*softplus(s)."""
    y, s = F.col(label).cast("double"), F.col(logit).cast("double")
    row = F.lit(pos_weight) * y * softplus(-s) + (F.lit(1.0) - y) * softplus(s)
    return df.groupBy(*group).agg(F.avg(row).alias("loss"), F.count(F.lit(1)).alias("num_rows"))


def listwise_loss(df: DataFrame, group: Sequence[str] = (), label: str = "label",
                  logit: str = "score", strict: bool = False, rows: int | None = None) -> DataFrame:
    """Softmax cross-entropy of the positive per qid, averaged over qids,
    with group hit@1/3/5 and MRR of the positive's position (W1 tie-break).

    A group must have exactly one positive (V5): the others have no such loss
    and are counted in num_left_out, or raise when the result is read if
    ``strict``.
    The log-sum-exp is a two-level aggregate (max, then sum of exp(s - max)),
    so a hot qid never sits in one task.  ``rows``, a bound of the number of
    rows where it is known, gives many rows more tasks than the session's.
    """
    keys = [*group, "qid"]
    s = F.col(logit).cast("double")
    base = df.select(*keys, "context_id", s.alias("s"), F.col(label).cast("int").alias("y"))
    base = base if rows is None else spread(base, rows, *keys)
    stats = base.groupBy(*keys).agg(F.max("s").alias("m"), F.sum("y").alias("npos"),
                                    F.max(F.when(F.col("y") == 1, F.col("s"))).alias("s_pos"),
                                    F.max(F.when(F.col("y") == 1, F.col("context_id"))).alias("c_pos"))
    bad = F.raise_error(F.concat(F.lit("group "), F.col("qid").cast("string"), F.lit(
        " must have exactly one positive"))).cast("double") if strict else F.lit(None).cast("double")
    stats = stats.withColumn("s_pos", F.when(F.col("npos") == 1, F.col("s_pos")).otherwise(bad))
    ahead = (base.join(stats, keys)
             .groupBy(*keys).agg(
                 F.first("m").alias("m"), F.first("s_pos").alias("s_pos"),
                 F.sum(F.exp(F.col("s") - F.col("m"))).alias("z"),
                 F.sum(F.when((F.col("s") > F.col("s_pos")) |
                              ((F.col("s") == F.col("s_pos")) & (F.col("context_id") < F.col("c_pos"))), 1)
                       .otherwise(0)).alias("n_ahead")))
    sound = F.col("s_pos").isNotNull()
    per_q = ahead.select(*keys, (F.col("m") + F.log(F.col("z")) - F.col("s_pos")).alias("ce"),
                         F.when(sound, F.col("n_ahead") + 1).alias("pos"), sound.alias("sound"))
    sound_pos = F.col("pos")
    out = per_q.groupBy(*group).agg(
        F.avg("ce").alias("loss"), F.count("ce").alias("num_groups"),
        F.count(F.when(~F.col("sound"), 1)).alias("num_left_out"),
        *[F.avg(F.when(sound_pos <= k, 1.0).when(sound_pos > k, 0.0)).alias(f"val_p{k}") for k in (1, 3, 5)],
        F.avg(F.lit(1.0) / sound_pos).alias("val_mrr"))
    return out
