"""Queries over the easy (qa) candidate set: features, expression scorers,
error cases with text, vocabulary, encoding, group rows, MLlib and plug-in
scorers (M1-M12, E4, J3, J4, P5, A18, K5, T10-T14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankscope.operators.compare import attach_context_text, identify_cases, method_stats_long, method_stats_wide
from rankscope.operators.models import train_lightweight
from rankscope.operators.ranking import rank_scores
from rankscope.operators.sampling import split_by_qid
from rankscope.operators.scoring import (baseline_scores, bonus_scores, build_features, char_histogram_scorer,
                                         score_pairs)
from rankscope.operators.sequences import build_vocab, encode_pairs, group_rows
from rankscope.plans import sql_text as S
from rankscope.plans.builders import QA_EASY_SQL, easy_candidates
from rankscope.plans.catalog import register
from rankscope.plans.comparison import stats_sql
from rankscope.session import materialize

SEED, TEST_SIZE, MAX_LENGTH, BONUS = 42, 0.25, 256, 0.05
# two weak expression scorers, so that error cases (with texts) actually occur
TEXT_METHODS = ["context_length", "length_ratio"]


def _r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Easy candidates with embedding_score rounded to 6 places (the SQL
    oracle's value, so ranking ties break the same way in both engines)."""
    return easy_candidates(spark, sf_dir).withColumn("embedding_score", F.round("embedding_score", 6))


def qa_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rounded_candidates``, written once for queries that read them more than once."""
    return materialize(rounded_candidates(spark, sf_dir))


EASY = QA_EASY_SQL


@register("pair_features", f"""
WITH {EASY}
SELECT qid, context_id, label, embedding_score,
  round({S.jaccard(S.bigrams('question'), S.bigrams('candidate_context'))}, 6) AS keyword_overlap,
  CASE WHEN question_department IS NOT DISTINCT FROM department THEN 1.0 ELSE 0.0 END AS department_match,
  round(least(coalesce(length(question), 0), 500) / 500.0, 6) AS question_length,
  round(least(coalesce(length(candidate_context), 0), 1500) / 1500.0, 6) AS context_length,
  round(CASE WHEN greatest(length(question), length(candidate_context)) > 0
        THEN least(length(question), length(candidate_context)) / greatest(length(question), length(candidate_context))
        ELSE 0.0 END, 6) AS length_ratio
FROM easy""")
def q_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6(build_features(qa_candidates(spark, sf_dir)))


def _w1_sql(score_expr: str, method: str) -> str:
    return f"""
SELECT qid, context_id, round({score_expr}, 6) AS score,
  CAST(ROW_NUMBER() OVER (PARTITION BY qid ORDER BY {score_expr} DESC NULLS LAST, context_id) AS INTEGER) AS rank,
  '{method}' AS method, 0.0 AS latency_ms
FROM easy"""


BONUS_EXPR = (f"(COALESCE(embedding_score, 0.0) + CASE WHEN question_department IS NOT DISTINCT FROM department "
              f"THEN {BONUS} ELSE 0.0 END)")


CL_EXPR = "(least(coalesce(length(candidate_context), 0), 1500) / 1500.0)"
LR_EXPR = ("(CASE WHEN greatest(length(question), length(candidate_context)) > 0 THEN least(length(question), "
           "length(candidate_context)) / greatest(length(question), length(candidate_context)) ELSE 0.0 END)")


@register("baseline_scores", f"WITH {EASY} {_w1_sql('embedding_score', 'embedding_baseline')}")
def q_baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6(baseline_scores(qa_candidates(spark, sf_dir)))


@register("bonus_scores", f"WITH {EASY} {_w1_sql(BONUS_EXPR, 'embedding_department_bonus')}")
def q_bonus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r6(bonus_scores(qa_candidates(spark, sf_dir), BONUS))


def _text_cases_sql() -> str:
    scores = (f"scores AS ({_w1_sql(CL_EXPR, 'context_length')} UNION ALL "
              f"{_w1_sql(LR_EXPR, 'length_ratio')})")
    base = f"{EASY}, {scores}"
    st = stats_sql(TEXT_METHODS, base, "cand AS (SELECT qid, context_id, label = 1 AS is_pos FROM easy)")
    wrong = " AND ".join(f"({m}_positive_rank IS NULL OR {m}_positive_rank > 1)" for m in TEXT_METHODS)
    cols = ["qid", "case_type", "question", "positive_context_id", "positive_context"]
    for sfx in ("positive_rank", "positive_score", "top1_context_id", "top1_score"):
        cols += [f"{m}_{sfx}" for m in TEXT_METHODS]
    sel = [f"round(c.{x}, 6) AS {x}" if x.endswith("_score") else x for x in cols[5:]]
    joins, extra = [], []
    for i, m in enumerate(TEXT_METHODS):
        joins.append(f"LEFT JOIN easy t{i} ON t{i}.qid = c.qid AND t{i}.context_id = c.{m}_top1_context_id")
        extra.append(f"t{i}.source_type AS {m}_top1_source_type")
    for i, m in enumerate(TEXT_METHODS):
        extra.append(f"CASE WHEN length(coalesce(t{i}.candidate_context, '')) <= 500 THEN coalesce(t{i}.candidate_context, '') "
                     f"ELSE substring(t{i}.candidate_context, 1, 500) || '...' END AS {m}_top1_context")
    return f"""
WITH {st},
cases AS (SELECT wide.*, 'all_available_wrong' AS case_type FROM wide WHERE {wrong}),
posq AS (SELECT qid, question, context_id AS positive_context_id, candidate_context AS pc FROM easy WHERE label = 1)
SELECT c.qid, c.case_type, posq.question, posq.positive_context_id,
  CASE WHEN length(coalesce(posq.pc, '')) <= 500 THEN coalesce(posq.pc, '') ELSE substring(posq.pc, 1, 500) || '...' END
    AS positive_context,
  {", ".join(sel)}, {", ".join(extra)}
FROM cases c LEFT JOIN posq ON posq.qid = c.qid {" ".join(joins)}"""


@register("error_cases_with_text", _text_cases_sql())
def q_error_cases_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = qa_candidates(spark, sf_dir).withColumn("is_positive", F.col("label") == 1)
    feats = build_features(cand)
    scores = rank_scores(feats.select("qid", "context_id", F.col("context_length").alias("score")),
                         "context_length").unionByName(
        rank_scores(feats.select("qid", "context_id", F.col("length_ratio").alias("score")), "length_ratio"))
    stats = method_stats_wide(method_stats_long(cand, scores, TEXT_METHODS), TEXT_METHODS)
    cases = identify_cases(stats, TEXT_METHODS)
    return _r6(attach_context_text(cases, cand, TEXT_METHODS, 500))


@register("char_vocabulary", f"""
WITH ch AS (SELECT unnest(string_split({S.clean('text')}, '')) AS ch FROM documents),
c AS (SELECT ch, COUNT(*) AS count FROM ch WHERE ch <> '' GROUP BY ch)
SELECT ch, count, CAST(ROW_NUMBER() OVER (ORDER BY count DESC, ch) + 3 AS INTEGER) AS id FROM c
UNION ALL SELECT ch, CAST(count AS BIGINT), id FROM (VALUES ('[PAD]', NULL, 0), ('[UNK]', NULL, 1), ('[CLS]', NULL, 2),
                                                   ('[SEP]', NULL, 3)) t(ch, count, id)""")
def q_char_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return build_vocab(docs, ["text"])


def _encode_sql() -> str:
    mc = MAX_LENGTH - 3
    return f"""
{EASY},
sp AS (SELECT qid, CASE WHEN o <= CAST(ceil(n * {TEST_SIZE}) AS BIGINT) THEN 'test' ELSE 'train' END AS split
       FROM (SELECT qid, ROW_NUMBER() OVER (ORDER BY md5(concat_ws('|', '{SEED}', 'split', qid)), qid) AS o,
                    COUNT(*) OVER () AS n FROM (SELECT DISTINCT qid FROM easy))),
tr AS (SELECT e.* FROM easy e JOIN sp ON sp.qid = e.qid WHERE split = 'train'),
chs AS (SELECT unnest(string_split({S.clean('question')}, '')) AS ch FROM tr
        UNION ALL SELECT unnest(string_split({S.clean('candidate_context')}, '')) FROM tr),
cnt AS (SELECT ch, COUNT(*) AS c FROM chs WHERE ch <> '' GROUP BY ch),
voc AS (SELECT ch, CAST(ROW_NUMBER() OVER (ORDER BY c DESC, ch) + 3 AS INTEGER) AS id FROM cnt),
vm AS (SELECT map(list(ch), list(id)) AS m FROM voc),
b AS (SELECT qid, context_id, label,
             list_filter(string_split({S.clean('question')}, ''), lambda c: c <> '') AS qc,
             list_filter(string_split({S.clean('candidate_context')}, ''), lambda c: c <> '') AS cc FROM easy),
b2 AS (SELECT *, CAST(least(len(qc), greatest(CAST(ceil({mc} / 2) AS BIGINT), {mc} - len(cc))) AS BIGINT) AS qn,
              CAST(least(len(cc), greatest({mc} // 2, {mc} - len(qc))) AS BIGINT) AS cn FROM b),
enc AS (SELECT qid, context_id, label,
  list_resize(list_concat([2], list_transform(qc[1:qn], lambda c: coalesce(m[c], 1)), [3],
                          list_transform(cc[1:cn], lambda c: coalesce(m[c], 1)), [3]), {MAX_LENGTH}, 0) AS input_ids,
  list_resize(list_concat(list_resize([]::INTEGER[], qn + 2, 0), list_resize([]::INTEGER[], cn + 1, 1)), {MAX_LENGTH}, 0)
    AS token_type_ids,
  list_resize(list_resize([]::INTEGER[], qn + cn + 3, 1), {MAX_LENGTH}, 0) AS attention_mask
  FROM b2, vm)"""


def qa_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = qa_candidates(spark, sf_dir)
    train = cand.join(split_by_qid(cand, TEST_SIZE, SEED).where("split = 'train'"), "qid", "left_semi")
    vocab = build_vocab(train)
    return encode_pairs(cand, vocab, MAX_LENGTH, keep=("label", "source_type"))


@register("encode_pairs", f"WITH {_encode_sql()} SELECT * FROM enc")
def q_encode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_encoded(spark, sf_dir).drop("source_type")


@register("group_rows", f"""
WITH {_encode_sql()},
e2 AS (SELECT enc.*, easy.source_type FROM enc JOIN easy USING (qid, context_id)),
ok AS (SELECT qid FROM e2 GROUP BY qid HAVING COUNT(*) = 10 AND SUM(label) = 1)
SELECT qid, list(label ORDER BY source_type, context_id) AS labels,
  CAST(list_position(list(label ORDER BY source_type, context_id), 1) - 1 AS INTEGER) AS target,
  CAST(SUM(list_sum(attention_mask)) AS BIGINT) AS tokens
FROM e2 WHERE qid IN (SELECT qid FROM ok) GROUP BY qid""")
def q_group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = group_rows(qa_encoded(spark, sf_dir), 10)
    tokens = F.aggregate(F.flatten("attention_mask"), F.lit(0).cast("long"), lambda a, x: a + x)
    return g.select("qid", "labels", "target", tokens.alias("tokens"))


@register("logreg_scores")
def q_logreg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = train_lightweight(rounded_candidates(spark, sf_dir), "logreg", TEST_SIZE, SEED, "all")
    return scores


@register("forest_scores")
def q_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = train_lightweight(rounded_candidates(spark, sf_dir), "rf", TEST_SIZE, SEED, "all")
    return scores


@register("plug_in_scores")
def q_plug_in_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_pairs(qa_candidates(spark, sf_dir), char_histogram_scorer, "char_histogram", batch_size=64)


SUBSET_SEED, SUBSET_SHARE, SUBSET_LENGTH = 42, 0.25, 60


def length_scorer():
    """Scores a pair by how alike its lengths are; the scores of a batch do not depend on each other."""
    return lambda qs, cs: [-abs(len(q) - len(c)) for q, c in zip(qs, cs)]


@register("plug_in_test_scores", f"""
WITH {EASY}, k AS (SELECT DISTINCT qid FROM easy),
o AS (SELECT qid, ROW_NUMBER() OVER (ORDER BY md5(concat_ws('|', '{SUBSET_SEED}', 'split', qid)), qid) AS o FROM k),
t AS (SELECT qid FROM o WHERE o <= CAST(ceil((SELECT COUNT(*) FROM k) * {SUBSET_SHARE}) AS BIGINT)),
s AS (SELECT qid, context_id, CAST(-abs(least(length(question), {SUBSET_LENGTH})
             - least(length(candidate_context), {SUBSET_LENGTH})) AS DOUBLE) AS score FROM easy JOIN t USING (qid))
SELECT qid, context_id, score, CAST(ROW_NUMBER() OVER (PARTITION BY qid ORDER BY score DESC, context_id) AS INTEGER) AS rank,
       'length' AS method FROM s""")
def q_plug_in_test_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plug-in scorer over the test questions only."""
    cand = qa_candidates(spark, sf_dir)
    split = split_by_qid(cand, SUBSET_SHARE, SUBSET_SEED)
    return score_pairs(cand, length_scorer, "length", batch_size=48, max_length=SUBSET_LENGTH, split=split,
                       subset="test").drop("latency_ms")
