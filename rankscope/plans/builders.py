"""Candidate-builder queries: stratified sampling (X1-X3) and the easy set (Q1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankscope.operators.candidates import CANDIDATE_COLUMNS, STRIDES, build_easy_candidates
from rankscope.operators.sampling import (sample_by_targets, shuffle_ids, stratified_targets,
                                          two_department_targets)
from rankscope.plans import sql_text as S
from rankscope.plans.catalog import register
from rankscope.plans.text_queries import documents_corpus, qa_corpus

SEED = 42
# Sampling is the feature here: n questions stratified over the languages.
STRATIFIED_N = 100
# Easy set: every corpus row becomes a question.
EASY_N = None
EASY_HARD, EASY_RANDOM = 4, 5
QA_DEPARTMENTS = ("even", "odd")


def _md5(salt: str, key: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', '{salt}', {key}))"


def _hint(salt: str, key: str) -> str:
    return f"CAST('0x' || substring({_md5(salt, key)}, 1, 15) AS BIGINT)"


def _stride(salt: str, size: str) -> str:
    prime = f"([{', '.join(map(str, STRIDES))}])[1 + {_hint(salt + '_stride', 'qid')} % {len(STRIDES)}]"
    return f"CASE WHEN CAST({prime} AS BIGINT) % {size} = 0 THEN 1 ELSE CAST({prime} AS BIGINT) % {size} END"


@register("stratified_questions", f"""
WITH {S.CORPUS_RAW_CTE}, {S.load_cte('corpus_raw', 'corpus')},
depts AS (SELECT canonical_department AS d, ROW_NUMBER() OVER (ORDER BY canonical_department) - 1 AS i,
                 COUNT(*) OVER () AS nd FROM (SELECT DISTINCT canonical_department FROM corpus)),
tgt AS (SELECT d, CAST(floor({STRATIFIED_N} / nd) + CASE WHEN i < {STRATIFIED_N} % nd THEN 1 ELSE 0 END AS INTEGER) AS target
        FROM depts),
smp AS (SELECT x.* FROM (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY canonical_department
                                                        ORDER BY {_md5('sample', 'raw_id')}) AS s FROM corpus c) x
        JOIN tgt ON tgt.d = x.canonical_department WHERE s <= target),
q AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {_md5('shuffle', 'raw_id')}) AS qno FROM smp)
SELECT printf('qh%04d', qno) AS qid, qno, raw_id, canonical_department FROM q""")
def q_stratified_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents_corpus(spark, sf_dir)
    q = shuffle_ids(sample_by_targets(corpus, stratified_targets(corpus, STRATIFIED_N), SEED), SEED, "qh", 4)
    return q.select("qid", "qno", "raw_id", "canonical_department")


def easy_sql(raw: str, departments: tuple[str, ...] | None) -> str:
    """The easy set of a raw QA table; departments in the given order, else all by name."""
    h, r = EASY_HARD, EASY_RANDOM
    names = "TRUE" if departments is None else "canonical_department IN (" + ", ".join(f"'{d}'" for d in departments) + ")"
    order = "d" if departments is None else f"list_position({list(departments)}, d)"
    return f"""
{raw}, {S.load_cte(raw.split(" AS ")[0].strip(), 'corpus')},
c AS (SELECT * FROM corpus WHERE {names}),
sizes AS (SELECT d, m, CAST(SUM(m) OVER (ORDER BY {order}) - m AS BIGINT) AS off, CAST(SUM(m) OVER () AS BIGINT) AS total
          FROM (SELECT canonical_department AS d, COUNT(*) AS m FROM c GROUP BY 1)),
q AS (SELECT *, printf('q%04d', ROW_NUMBER() OVER (ORDER BY {_md5('shuffle', 'raw_id')})) AS qid,
             ROW_NUMBER() OVER (ORDER BY {_md5('shuffle', 'raw_id')}) AS qno FROM c),
pool AS (SELECT s.d, raw_id, context, pool_pos, s.off + pool_pos AS place
         FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY canonical_department ORDER BY {_md5('pool', 'raw_id')}) - 1 AS pool_pos
               FROM c) p JOIN sizes s ON s.d = p.canonical_department),
qp AS (SELECT q.qid, q.qno, q.ask, q.context, s.d, p.pool_pos, s.m AS pool_size, s.off, s.total - s.m AS other_size
       FROM q JOIN pool p ON p.raw_id = q.raw_id JOIN sizes s ON s.d = q.canonical_department),
qp2 AS (SELECT *, GREATEST(LEAST({h}, pool_size - 1), 0) AS nh, LEAST({r}, other_size) AS nr FROM qp),
qp3 AS (SELECT *, SUM(1 + nh + nr) OVER (ORDER BY qno ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (1 + nh + nr) AS base,
               {_hint('hard', 'qid')} % pool_size AS sh, {_stride('hard', 'pool_size')} AS th,
               CASE WHEN other_size > 0 THEN {_hint('random', 'qid')} % other_size END AS sr,
               CASE WHEN other_size > 0 THEN {_stride('random', 'other_size')} END AS tr
        FROM qp2),
hj AS (SELECT *, (sh + j * th) % pool_size AS pos FROM (SELECT *, unnest(range(0, nh + 1)) AS j FROM qp3)),
ho AS (SELECT *, MAX(CASE WHEN pos = pool_pos THEN j END) OVER (PARTITION BY qid) AS own FROM hj),
hd AS (SELECT qid, base, off + pos AS place, CASE WHEN j > own THEN j - 1 ELSE j END + 1 AS slot,
              'hard_negative' AS source_type
       FROM ho WHERE pos <> pool_pos AND CASE WHEN j > own THEN j - 1 ELSE j END < nh),
rj AS (SELECT *, (sr + j * tr) % other_size AS pos FROM (SELECT *, unnest(range(0, nr)) AS j FROM qp3 WHERE nr > 0)),
rn AS (SELECT qid, base, CASE WHEN pos < off THEN pos ELSE pos + pool_size END AS place, nh + 1 + j AS slot,
              'random_negative' AS source_type FROM rj),
picked AS (SELECT x.qid, x.base, x.slot, p.context AS candidate_context, p.d AS department, x.source_type, 0 AS label
           FROM (SELECT * FROM hd UNION ALL SELECT * FROM rn) x JOIN pool p ON p.place = x.place),
pos_rows AS (SELECT qid, base, 0 AS slot, context AS candidate_context, d AS department, 'positive' AS source_type, 1 AS label
        FROM qp3),
rows AS (SELECT u.*, q.ask AS question, q.d AS question_department, printf('c%06d', u.base + u.slot + 1) AS context_id
         FROM (SELECT * FROM pos_rows UNION ALL SELECT * FROM picked) u JOIN qp3 q ON q.qid = u.qid),
docs AS (SELECT t AS k, t, COUNT(*) AS m FROM (SELECT question AS t FROM rows UNION ALL
                                               SELECT candidate_context FROM rows) GROUP BY t),
{S.tfidf_ctes('docs')},
dots AS (SELECT r.context_id, SUM(a.w * b.w) AS s FROM rows r JOIN tf_vec a ON a.k = r.question
         JOIN tf_vec b ON b.k = r.candidate_context AND b.g = a.g GROUP BY r.context_id),
easy AS MATERIALIZED (SELECT qid, question, context_id, candidate_context, label, department, source_type,
                round(COALESCE(dots.s, 0.0), 6) AS embedding_score, question_department
         FROM rows LEFT JOIN dots USING (context_id))"""


QA_EASY_SQL = easy_sql(S.QA_RAW_CTE, QA_DEPARTMENTS)


def easy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_easy_candidates(qa_corpus(spark, sf_dir), EASY_N, EASY_HARD, EASY_RANDOM, SEED, QA_DEPARTMENTS)


@register("easy_candidates", f"WITH {QA_EASY_SQL} SELECT * FROM easy")
def q_easy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = easy_candidates(spark, sf_dir)
    return e.withColumn("embedding_score", F.round("embedding_score", 6)).select(*CANDIDATE_COLUMNS)


@register("easy_candidates_languages", f"WITH {easy_sql(S.CORPUS_RAW_CTE, None)} SELECT * FROM easy")
def q_easy_candidates_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The easy set of the documents corpus: each language is a department, random negatives come from all others."""
    e = build_easy_candidates(documents_corpus(spark, sf_dir), EASY_N, EASY_HARD, EASY_RANDOM, SEED, None)
    return e.withColumn("embedding_score", F.round("embedding_score", 6)).select(*CANDIDATE_COLUMNS)


# Sampling is the feature; the first department has half of the questions, rounded down, the second the rest.
TWO_N = 61


@register("two_department_questions", f"""
WITH {S.QA_RAW_CTE}, {S.load_cte('qa_raw', 'corpus')},
m AS (SELECT COUNT(*) FILTER (canonical_department = '{QA_DEPARTMENTS[0]}') AS a,
             COUNT(*) FILTER (canonical_department = '{QA_DEPARTMENTS[1]}') AS b FROM corpus),
f AS (SELECT a, b, LEAST(b, {TWO_N} - LEAST(a, {TWO_N // 2})) AS second FROM m),
t AS (SELECT '{QA_DEPARTMENTS[0]}' AS d, LEAST(a, {TWO_N} - second) AS target FROM f
      UNION ALL SELECT '{QA_DEPARTMENTS[1]}', second FROM f),
s AS (SELECT c.*, ROW_NUMBER() OVER (PARTITION BY canonical_department ORDER BY {_md5('sample', 'raw_id')}) AS n FROM corpus c),
k AS (SELECT s.* FROM s JOIN t ON t.d = s.canonical_department WHERE n <= target)
SELECT printf('q%04d', ROW_NUMBER() OVER (ORDER BY {_md5('shuffle', 'raw_id')})) AS qid, raw_id, canonical_department
FROM k""")
def q_two_department_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = qa_corpus(spark, sf_dir)
    targets = two_department_targets(corpus, TWO_N, QA_DEPARTMENTS)
    return shuffle_ids(sample_by_targets(corpus, targets, SEED), SEED, "q", 4).select("qid", "raw_id",
                                                                                     "canonical_department")
