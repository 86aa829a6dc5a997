"""Quality, split, classification, loss and run-selection queries
(V1-V6, A6-A10, X7, J6, U3, A13, A14, A16, A17, M12, P17, W4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankscope.operators.metrics import (classification_metrics, listwise_loss, pointwise_loss,
                                         threshold_labels)
from rankscope.operators.quality import candidate_violations, dataset_profile
from rankscope.operators.runs import best_epochs
from rankscope.operators.sampling import split_by_qid
from rankscope.plans.catalog import register
from rankscope.plans.sql_ranked import RANKED_CTE
from rankscope.sources.adapters import RANKED_METHODS, judged, ranked_candidates, ranked_groups, ranked_raw_scores, runs
from rankscope.sources.tables import table

SEED = 42
TEST_SIZE = 0.25
PATIENCE = 5
POS_WEIGHT = 9.0


def _r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("group_split", f"""
WITH {RANKED_CTE}, q AS (SELECT DISTINCT qid FROM g),
o AS (SELECT qid, ROW_NUMBER() OVER (ORDER BY md5(concat_ws('|', '{SEED}', 'split', CAST(qid AS VARCHAR))), qid) AS o
      FROM q)
SELECT qid, CASE WHEN o <= CAST(ceil((SELECT COUNT(*) FROM q) * {TEST_SIZE}) AS BIGINT) THEN 'test' ELSE 'train' END AS split
FROM o""")
def q_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_by_qid(ranked_candidates(ranked_groups(spark, sf_dir)), TEST_SIZE, SEED)


@register("candidate_violations", f"""
WITH {RANKED_CTE},
pq AS (SELECT qid, COUNT(*) AS n, SUM(label) AS npos FROM g GROUP BY qid)
SELECT 'no_positive' AS rule, CAST(qid AS VARCHAR) AS qid, CAST(npos AS VARCHAR) AS detail FROM pq WHERE npos < 1
UNION ALL
SELECT 'positives_not_one', CAST(qid AS VARCHAR), CAST(npos AS VARCHAR) FROM pq WHERE npos <> 1
UNION ALL
SELECT 'duplicate_key', CAST(qid AS VARCHAR), CAST(context_id AS VARCHAR) || ':' || CAST(k AS VARCHAR)
FROM (SELECT qid, context_id, COUNT(*) AS k FROM lineitem_keys GROUP BY qid, context_id) WHERE k > 1""".replace(
    "lineitem_keys", "(SELECT l_orderkey AS qid, l_linenumber AS context_id FROM lineitem)"))
def q_candidate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ranked_groups(spark, sf_dir)
    # candidates = the raw lines (duplicate keys kept) with the per-key label
    lines = (spark.read.parquet(f"{sf_dir}/lineitem.parquet")
             .select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("context_id")))
    cand = ranked_candidates(g)
    v = candidate_violations(cand, exactly_one_positive=True)
    dups = candidate_violations(lines.withColumn("label", F.lit(1))).where(F.col("rule") == "duplicate_key")
    return v.where(F.col("rule") != "duplicate_key").unionByName(dups)


@register("dataset_profile", f"""
WITH {RANKED_CTE},
sz AS (SELECT qid, COUNT(*) AS size FROM g GROUP BY qid)
SELECT 'total' AS section, 'rows' AS item, COUNT(*) AS count FROM g
UNION ALL SELECT 'label', CAST(label AS VARCHAR), COUNT(*) FROM g GROUP BY label
UNION ALL SELECT 'total', 'qids', COUNT(*) FROM sz
UNION ALL SELECT 'group_size', CAST(size AS VARCHAR), COUNT(*) FROM sz GROUP BY size""")
def q_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_profile(ranked_candidates(ranked_groups(spark, sf_dir)))


JUDGED_CTE = """
j AS (SELECT l.doc_id, d.lang AS grp, l.quality AS label, (CAST(d.n_chars AS DOUBLE) - 2000.0) / 1000.0 AS logit
      FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
jp AS (SELECT *, 1.0 / (1.0 + exp(-logit)) AS prob FROM j)"""


@register("classification_metrics", f"""
WITH {JUDGED_CTE},
c AS (SELECT grp AS "group",
        CAST(SUM(CASE WHEN label = 0 AND prob < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
        CAST(SUM(CASE WHEN label = 0 AND prob >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(SUM(CASE WHEN label = 1 AND prob < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        CAST(SUM(CASE WHEN label = 1 AND prob >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp
      FROM jp GROUP BY grp),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT "group", round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, tn, fp, fn, tp FROM m""")
def q_classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir).withColumn("pred", threshold_labels("prob"))
    return _r6(classification_metrics(j, group=["group"]))


@register("pointwise_loss", f"""
WITH {JUDGED_CTE}
SELECT grp AS "group",
  round(AVG({POS_WEIGHT} * label * (greatest(-logit, 0) + ln(1 + exp(-abs(logit))))
            + (1 - label) * (greatest(logit, 0) + ln(1 + exp(-abs(logit))))), 6) AS loss,
  COUNT(*) AS num_rows
FROM j GROUP BY grp""")
def q_pointwise_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    return _r6(pointwise_loss(j, "label", "logit", POS_WEIGHT, group=["group"]))


@register("listwise_loss", f"""
WITH {RANKED_CTE},
b AS (SELECT r.method, r.qid, r.context_id, r.score / 1000.0 AS s, g.label AS y FROM raw r JOIN g USING (qid, context_id)),
st AS (SELECT method, qid, MAX(s) AS m, SUM(y) AS npos, MAX(CASE WHEN y = 1 THEN s END) AS s_pos,
              MAX(CASE WHEN y = 1 THEN context_id END) AS c_pos FROM b GROUP BY method, qid HAVING SUM(y) = 1),
pq AS (SELECT b.method, b.qid, MAX(st.m) + ln(SUM(exp(b.s - st.m))) - MAX(st.s_pos) AS ce,
              SUM(CASE WHEN b.s > st.s_pos OR (b.s = st.s_pos AND b.context_id < st.c_pos) THEN 1 ELSE 0 END) + 1 AS pos
       FROM b JOIN st ON st.method = b.method AND st.qid = b.qid GROUP BY b.method, b.qid),
al AS (SELECT method, COUNT(DISTINCT qid) AS n FROM b GROUP BY method)
SELECT method, round(AVG(ce), 6) AS loss, COUNT(*) AS num_groups, MAX(n) - COUNT(*) AS num_left_out,
  round(AVG(CASE WHEN pos <= 1 THEN 1.0 ELSE 0.0 END), 6) AS val_p1,
  round(AVG(CASE WHEN pos <= 3 THEN 1.0 ELSE 0.0 END), 6) AS val_p3,
  round(AVG(CASE WHEN pos <= 5 THEN 1.0 ELSE 0.0 END), 6) AS val_p5,
  round(AVG(1.0 / pos), 6) AS val_mrr
FROM pq JOIN al USING (method) GROUP BY method""")
def q_listwise_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ranked_groups(spark, sf_dir)
    rows = len(RANKED_METHODS) * table(spark, sf_dir, "lineitem", "l_orderkey").count()  # groups are at most the lines
    b = (ranked_raw_scores(g).join(ranked_candidates(g), ["qid", "context_id"])
         .withColumn("score", F.col("score") / 1000.0))
    return _r6(listwise_loss(b, group=["method"], rows=rows))


@register("best_epoch", f"""
WITH r AS (SELECT user_id AS run_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch,
                  value AS metric FROM events),
a AS (SELECT *, MAX(metric) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM r),
b AS (SELECT *, prev IS NULL OR COALESCE(metric > prev, false) AS is_improvement FROM a),
c AS (SELECT *, CAST(epoch - MAX(CASE WHEN is_improvement THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS no_improve_epochs FROM b),
d AS (SELECT *, MIN(CASE WHEN no_improve_epochs >= {PATIENCE} THEN epoch END) OVER (PARTITION BY run_id) AS stop_epoch FROM c),
e AS (SELECT *, stop_epoch IS NULL OR epoch <= stop_epoch AS kept FROM d),
f AS (SELECT *, MAX(CASE WHEN is_improvement AND kept THEN epoch END) OVER (PARTITION BY run_id) AS best_epoch FROM e)
SELECT run_id, epoch, round(metric, 6) AS metric, is_improvement, no_improve_epochs, stop_epoch, kept, best_epoch,
       epoch = best_epoch AS is_best_epoch, stop_epoch IS NOT NULL AS early_stopped FROM f""")
def q_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = best_epochs(runs(spark, sf_dir), patience=PATIENCE)
    return _r6(out.select("run_id", "epoch", "metric", "is_improvement", "no_improve_epochs", "stop_epoch", "kept",
                          "best_epoch", "is_best_epoch", "early_stopped"))
