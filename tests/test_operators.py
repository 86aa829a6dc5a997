"""Comparison rules, sampling, quality, sequences, similarity on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankscope.operators.compare import build_summary, identify_cases, method_stats_long, method_stats_wide
from rankscope.operators.quality import candidate_violations, require
from rankscope.operators.sampling import split_by_qid
from rankscope.operators.sequences import encode_pairs, pair_lengths
from rankscope.operators.similarity import SparseBlock, top_indices


def test_case_rules_and_summary(spark):
    cand = spark.createDataFrame([("q1", "a", True), ("q1", "b", False), ("q2", "a", True), ("q2", "b", False)],
                                 "qid string, context_id string, is_positive boolean")
    sc = spark.createDataFrame([
        ("embedding_baseline", "q1", "a", 0.1, 2), ("embedding_baseline", "q1", "b", 0.9, 1),
        ("lightweight_ml", "q1", "a", 0.9, 1), ("lightweight_ml", "q1", "b", 0.1, 2),
        ("embedding_baseline", "q2", "a", 0.9, 1), ("embedding_baseline", "q2", "b", 0.1, 2)],
        "method string, qid string, context_id string, score double, rank int")
    methods = ["embedding_baseline", "lightweight_ml"]
    stats = method_stats_wide(method_stats_long(cand, sc, methods), methods)
    cases = {(r.qid, r.case_type) for r in identify_cases(stats, methods).collect()}
    assert cases == {("q1", "embedding_wrong_ml_correct")}
    summ = {(r.section, r.item): (r["count"], r.percentage) for r in build_summary(
        identify_cases(stats, methods), stats, methods).collect()}
    assert summ[("case_type", "embedding_wrong_ml_correct")] == (1, 0.5)
    assert summ[("method_rank", "lightweight_ml_rank_6_plus_or_missing")] == (1, 0.5)
    assert summ[("method_rank", "embedding_baseline_top3_hit")] == (2, 1.0)


def test_no_cases_row(spark):
    cand = spark.createDataFrame([("q1", "a", True)], "qid string, context_id string, is_positive boolean")
    sc = spark.createDataFrame([("m", "q1", "a", 1.0, 1)], "method string, qid string, context_id string, score double, rank int")
    stats = method_stats_wide(method_stats_long(cand, sc, ["m"]), ["m"])
    rows = build_summary(identify_cases(stats, ["m"]), stats, ["m"]).where("section = 'case_type'").collect()
    assert [(r.item, r["count"]) for r in rows] == [("no_cases_found", 0)]


@pytest.mark.parametrize("n,test", [(300, 75), (500, 125), (7, 2)])
def test_split_sizes(spark, n, test):
    df = spark.range(n).select(F.format_string("q%04d", "id").alias("qid"))
    sp = split_by_qid(df, 0.25, 42)
    counts = {r.split: r["count"] for r in sp.groupBy("split").count().collect()}
    assert counts == {"test": test, "train": n - test}
    assert sp.select("qid").distinct().count() == n


def test_violations_and_require(spark):
    cand = spark.createDataFrame([("q1", "a", 1), ("q1", "a", 0), ("q2", "b", 0)], "qid string, context_id string, label int")
    v = {(r.rule, r.qid) for r in candidate_violations(cand, exactly_one_positive=True).collect()}
    assert ("no_positive", "q2") in v and ("duplicate_key", "q1") in v and ("positives_not_one", "q2") in v
    with pytest.raises(ValueError):
        require(candidate_violations(cand))


#: question length, context length, room, what is left of both
TRUNCATED = [(0, 0, 5, 0, 0), (3, 4, 10, 3, 4), (3, 9, 10, 3, 7), (9, 3, 10, 7, 3), (9, 9, 10, 5, 5), (9, 9, 11, 6, 5),
             (8, 9, 11, 6, 5), (9, 8, 11, 6, 5), (20, 0, 7, 7, 0), (0, 20, 7, 0, 7), (5, 5, 0, 0, 0), (5, 5, 1, 1, 0),
             (1, 30, 4, 1, 3), (30, 1, 4, 3, 1), (2, 30, 4, 2, 2), (30, 2, 4, 2, 2)]


def test_pair_truncation(spark):
    for room in sorted({r[2] for r in TRUNCATED}):
        rows = [r for r in TRUNCATED if r[2] == room]
        df = spark.createDataFrame(rows, "q int, c int, m int, wq int, wc int")
        left, right = pair_lengths(F.col("q"), F.col("c"), room)
        assert df.where((left != F.col("wq")) | (right != F.col("wc"))).count() == 0


def test_encode_pairs_layout(spark):
    vocab = spark.createDataFrame([("[PAD]", None, 0), ("[UNK]", None, 1), ("[CLS]", None, 2), ("[SEP]", None, 3),
                                   ("a", 5, 4), ("b", 3, 5)], "ch string, count long, id int")
    df = spark.createDataFrame([("q", "c", "ab", "bz", 1)], "qid string, context_id string, question string, candidate_context string, label int")
    r = encode_pairs(df, vocab, 8).first()
    assert list(r.input_ids) == [2, 4, 5, 3, 5, 1, 3, 0]
    assert list(r.token_type_ids) == [0, 0, 0, 0, 1, 1, 1, 0]
    assert list(r.attention_mask) == [1, 1, 1, 1, 1, 1, 1, 0]
    r = encode_pairs(df, vocab, 4).first()
    assert list(r.input_ids) == [2, 4, 3, 3]


def test_sparse_block_scores_and_topk():
    blk = SparseBlock([np.array([1, 2]), np.array([2, 3]), np.array([], dtype=np.int64)],
                      [np.array([0.6, 0.8]), np.array([1.0, 0.0]), np.array([])])
    s = blk.scores(np.array([2, 9]), np.array([1.0, 5.0]))
    assert s.tolist() == pytest.approx([0.8, 1.0, 0.0])
    idx = top_indices(np.array([0.5, 0.9, 0.9, 0.1]), np.array([3, 2, 1, 0]), np.ones(4, bool), 2)
    assert idx.tolist() == [2, 1]
    assert math.isclose(blk.scores(np.array([7]), np.array([1.0])).sum(), 0.0)


def test_score_matrix_equals_postings():
    rng = np.random.default_rng(3)
    docs = [np.unique(rng.integers(0, 60, rng.integers(0, 25))) for _ in range(200)]
    wts = [rng.random(len(d)) for d in docs]
    blk = SparseBlock(docs, wts)
    qs = [np.unique(rng.integers(0, 80, rng.integers(0, 30))) for _ in range(17)]
    qw = [rng.random(len(q)) for q in qs]
    mat = blk.score_matrix(qs, qw)
    for i in range(len(qs)):
        assert np.allclose(mat[i], blk.scores(qs[i], qw[i]))


def test_row_cosine(spark):
    from rankscope.operators.similarity import row_cosine

    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(row_cosine("a", "b").alias("c")).collect()]
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and got[1] == 0.0
