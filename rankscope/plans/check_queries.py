"""Queries of checks and small operators: V2, V3, A8, U3, V6, J2, T7, T9, P9, P17, S4."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankscope.functions.numeric import sigmoid
from rankscope.operators.compare import missing_ranks
from rankscope.operators.corpus import CORPUS_COLUMNS, load_sources
from rankscope.operators.quality import hard_set_violations, score_violations, source_counts_by_qid, split_leaks
from rankscope.operators.ranking import rank_scores
from rankscope.operators.sampling import split_by_qid
from rankscope.operators.similarity import similarity
from rankscope.plans import sql_text as S
from rankscope.plans.catalog import register
from rankscope.plans.sql_ranked import RANKED_CTE
from rankscope.sources.adapters import judged, qa_raw, ranked_candidates, ranked_groups, ranked_raw_scores, vectors
from rankscope.sources.csv import positive_mask
from rankscope.sources.tables import table

EXPECTED = ("embedding_baseline", "bce")
SEEDS = (42, 43)
TEST_SIZE = 0.25


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@register("score_violations", f"""
WITH {RANKED_CTE}
SELECT DISTINCT 'unexpected_method' AS rule, CAST(qid AS VARCHAR) AS qid, method AS detail
FROM scores WHERE method NOT IN {_in(EXPECTED)}""")
def q_score_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_violations(rank_scores(ranked_raw_scores(ranked_groups(spark, sf_dir))), EXPECTED)


#: A hard set whose groups hold two lines of status O and two of status F.
HARD_SOURCES = {"O": 2, "F": 2}


@register("hard_set_violations", f"""
WITH c AS (SELECT l_orderkey AS qid, l_linenumber AS context_id, l_linestatus AS source_type,
                  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
q AS (SELECT qid, COUNT(*) AS n, SUM(label) AS npos, SUM(CASE WHEN source_type = 'O' THEN 1 ELSE 0 END) AS o,
             SUM(CASE WHEN source_type = 'F' THEN 1 ELSE 0 END) AS f FROM c GROUP BY qid)
SELECT 'no_positive' AS rule, CAST(qid AS VARCHAR) AS qid, CAST(npos AS VARCHAR) AS detail FROM q WHERE npos < 1
UNION ALL SELECT 'positives_not_one', CAST(qid AS VARCHAR), CAST(npos AS VARCHAR) FROM q WHERE npos <> 1
UNION ALL SELECT 'group_size', CAST(qid AS VARCHAR), CAST(n AS VARCHAR) FROM q WHERE n <> 4
UNION ALL SELECT 'source_count:O', CAST(qid AS VARCHAR), CAST(o AS VARCHAR) FROM q WHERE o <> 2
UNION ALL SELECT 'source_count:F', CAST(qid AS VARCHAR), CAST(f AS VARCHAR) FROM q WHERE f <> 2
UNION ALL SELECT DISTINCT 'source_type_not_allowed', CAST(qid AS VARCHAR), COALESCE(source_type, 'null') FROM c
          WHERE source_type IS NULL OR source_type NOT IN ('O', 'F')
UNION ALL SELECT 'duplicate_key', CAST(qid AS VARCHAR), CAST(context_id AS VARCHAR) || ':' || CAST(COUNT(*) AS VARCHAR)
          FROM c GROUP BY qid, context_id HAVING COUNT(*) > 1
UNION ALL SELECT 'row_count', NULL, CAST(COUNT(*) AS VARCHAR) FROM c HAVING COUNT(*) <> 100
UNION ALL SELECT 'qid_count', NULL, CAST(COUNT(DISTINCT qid) AS VARCHAR) FROM c HAVING COUNT(DISTINCT qid) <> 25""")
def q_hard_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag").select(
        F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("context_id"),
        F.col("l_linestatus").alias("source_type"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    return hard_set_violations(cand, 100, 25, HARD_SOURCES)


@register("source_counts", """
SELECT l_orderkey AS qid, l_linestatus AS source_type, COUNT(*) AS count FROM lineitem GROUP BY ALL""")
def q_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus")
    return source_counts_by_qid(cand.toDF("qid", "source_type"))


def _split_sql(seed: int) -> str:
    return f"""SELECT qid, CASE WHEN ROW_NUMBER() OVER (ORDER BY md5(concat_ws('|', '{seed}', 'split', CAST(qid AS VARCHAR))), qid)
        <= CAST(ceil((SELECT COUNT(*) FROM q) * {TEST_SIZE}) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM q"""


@register("split_leaks", f"""
WITH {RANKED_CTE}, q AS (SELECT DISTINCT qid FROM g),
s AS ({" UNION ALL ".join(f"SELECT * FROM ({_split_sql(seed)})" for seed in SEEDS)})
SELECT 'qid_in_several_splits' AS rule, CAST(qid AS VARCHAR) AS qid, CAST(COUNT(DISTINCT split) AS VARCHAR) AS detail
FROM s GROUP BY qid HAVING COUNT(DISTINCT split) > 1""")
def q_split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = ranked_candidates(ranked_groups(spark, sf_dir))
    return split_leaks(reduce(DataFrame.unionByName, [split_by_qid(cand, TEST_SIZE, s) for s in SEEDS]))


@register("missing_ranks", f"""
WITH {RANKED_CTE}, m AS (SELECT unnest(['embedding_baseline', 'bce', 'lightweight_ml', 'absent']) AS method),
s AS (SELECT * FROM scores WHERE NOT (method = 'bce' AND context_id = 2))
SELECT m.method, (SELECT COUNT(*) FROM g) - COUNT(s.qid) AS n_missing FROM m LEFT JOIN s ON s.method = m.method
GROUP BY m.method""")
def q_missing_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ranked_groups(spark, sf_dir)
    scores = rank_scores(ranked_raw_scores(g))
    scores = scores.union(scores).where(~((F.col("method") == "bce") & (F.col("context_id") == 2)))
    return missing_ranks(ranked_candidates(g), scores, ["embedding_baseline", "bce", "lightweight_ml", "absent"])


@register("vector_pair_cosine", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6)
       AS similarity
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def q_vector_pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    out = similarity(pairs, "vec_id", "embedding", "other", backend="vectors")
    return out.withColumn("similarity", F.round("similarity", 6))


@register("positive_rows", """
WITH l AS (SELECT CAST(quality AS VARCHAR) AS label, toxic AS is_positive,
                  CASE WHEN quality = 1 THEN 'Gold' ELSE 'hard_negative' END AS source_type FROM labels)
SELECT 'label' AS form, COUNT(*) AS n_rows, SUM(CASE WHEN label = '1' THEN 1 ELSE 0 END) AS n_positive FROM l
UNION ALL SELECT 'is_positive', COUNT(*), SUM(CASE WHEN is_positive = 1 THEN 1 ELSE 0 END) FROM l
UNION ALL SELECT 'source_type', COUNT(*), SUM(CASE WHEN source_type = 'Gold' THEN 1 ELSE 0 END) FROM l""")
def q_positive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels", "quality", "toxic")
    forms = {"label": F.col("quality").cast("string"), "is_positive": F.col("toxic"),
             "source_type": F.when(F.col("quality") == 1, "Gold").otherwise("hard_negative")}
    parts = []
    for name, column in forms.items():
        df = lab.select(column.alias(name))
        parts.append(df.agg(F.lit(name).alias("form"), F.count(F.lit(1)).alias("n_rows"),
                            F.sum(positive_mask(df).cast("long")).alias("n_positive")))
    return reduce(DataFrame.unionByName, parts)


@register("sigmoid_scores", """
WITH j AS (SELECT l.doc_id, (CAST(d.n_chars AS DOUBLE) - 2000.0) / 1000.0 AS logit
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT doc_id, round(1.0 / (1.0 + exp(-logit)), 6) AS probability FROM j""")
def q_sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("doc_id", F.round(sigmoid("logit"), 6).alias("probability"))


@register("multi_source_load", f"WITH {S.QA_RAW_CTE}, {S.load_cte('qa_raw', 'corpus')} "
                               f"SELECT {', '.join(CORPUS_COLUMNS)} FROM corpus")
def q_multi_source_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = qa_raw(spark, sf_dir)
    frames = {d: raw.where(F.col("department") == d) for d in ("even", "odd")}
    return load_sources(frames, ["conv_id", "turn"]).select(*CORPUS_COLUMNS)
