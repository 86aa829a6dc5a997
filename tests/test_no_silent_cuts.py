"""What used to be left out silently: whole texts, wrong methods, short samples, bad groups, mixed encodings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankscope.operators.metrics import listwise_loss
from rankscope.operators.ranking import range_number
from rankscope.operators.sampling import sample_by_targets, two_department_targets
from rankscope.operators.scoring import score_pairs
from rankscope.operators.sequences import group_rows
from rankscope.sources.csv import load_scores, read_csv_auto


def constant(value):
    def factory():
        return lambda qs, cs: np.full(len(qs), float(value))
    return factory


def test_every_scorer_gives_its_own_scores(spark):
    pairs = spark.createDataFrame([("q", "c", "x", "y")], "qid string, context_id string, question string, candidate_context string")
    for value in range(6):
        assert score_pairs(pairs, constant(value), "m").first().score == float(value)


def test_scorers_get_whole_texts(spark):
    pairs = spark.createDataFrame([("q", "c", "x" * 700, "y" * 900)],
                                  "qid string, context_id string, question string, candidate_context string")
    sizes = lambda: lambda qs, cs: np.array([len(q) * 10_000 + len(c) for q, c in zip(qs, cs)])
    assert score_pairs(pairs, sizes, "m").first().score == 7_000_900
    assert score_pairs(pairs, sizes, "m", max_length=512).first().score == 5_120_512


def test_scores_of_another_method_raise(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [("1", "2", 0.5, 1, "WRONG", 0.0)]
    spark.createDataFrame(rows, "qid string, context_id string, score double, rank int, method string, latency_ms double"
                          ).write.option("header", True).csv(path)
    with pytest.raises(Exception, match="method column must be bce"):
        load_scores(spark, {"bce": path}).collect()
    assert load_scores(spark, {"WRONG": path}).first().method == "WRONG"


def test_every_file_has_its_own_encoding(spark, tmp_path):
    text = "department,ask\n儿科,发烧\n"
    (tmp_path / "a.csv").write_bytes(text.encode("gb18030"))
    (tmp_path / "b.csv").write_bytes(text.encode("utf-8"))
    rows = read_csv_auto(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("儿科", "发烧")] * 2
    (tmp_path / "c.csv").write_bytes(b"department,ask\nx,1\ny,#N/A\n")
    rows = read_csv_auto(spark, str(tmp_path / "c.csv"), nrows=1).collect()
    assert [tuple(r) for r in rows] == [("x", "1")]
    assert read_csv_auto(spark, str(tmp_path / "c.csv")).where("ask is null").count() == 1


def corpus(spark):
    return spark.createDataFrame([(f"r{k}", "a" if k < 5 else "b") for k in range(12)],
                                 "raw_id string, canonical_department string")


def test_short_departments_raise(spark):
    with pytest.raises(ValueError, match="12"):
        two_department_targets(corpus(spark), 13, ["a", "b"])
    got = {r.canonical_department: r.target for r in two_department_targets(corpus(spark), 12, ["a", "b"]).collect()}
    assert got == {"a": 5, "b": 7}
    targets = spark.createDataFrame([("a", 6)], "canonical_department string, target long")
    with pytest.raises(ValueError, match="not enough rows"):
        sample_by_targets(corpus(spark), targets, 1)


def test_samples_above_the_rank_limit(spark):
    big = spark.range(3000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("raw_id"),
                                   F.lit("a").alias("canonical_department"))
    for n in (10, 2500):
        targets = spark.createDataFrame([("a", n)], "canonical_department string, target long")
        assert sample_by_targets(big, targets, 1).distinct().count() == n


def test_bad_groups_are_counted_or_raise(spark):
    rows = [("a", 1, 0.5, 1), ("a", 2, 0.1, 0), ("b", 1, 0.5, 0), ("c", 1, 0.5, 1), ("c", 2, 0.2, 1)]
    df = spark.createDataFrame(rows, "qid string, context_id int, score double, label int")
    got = listwise_loss(df).first()
    assert (got.num_groups, got.num_left_out, got.val_p1) == (1, 2, 1.0)
    with pytest.raises(Exception, match="exactly one positive"):
        listwise_loss(df, strict=True).collect()
    encoded = df.selectExpr("qid", "context_id", "label", "'x' as source_type", "array(1) as input_ids",
                            "array(0) as token_type_ids", "array(1) as attention_mask")
    with pytest.raises(Exception, match="must have 2 rows"):
        group_rows(encoded, 2).collect()
    assert group_rows(encoded.where("qid = 'a'"), 2).first().target == 0


def test_null_groups_are_numbered(spark):
    df = spark.range(40).select(F.when(F.col("id") % 2 == 0, F.lit("k")).alias("g"), "id")
    got = range_number(df, ["g"], [F.col("id").asc()], "n").orderBy("g", "id").collect()
    assert [r.n for r in got] == [*range(1, 21), *range(1, 21)]


def qa_rows(spark, rows):
    return spark.createDataFrame(rows, "canonical_department string, raw_id string, row_no long, ask string, "
                                       "answer string, context string, answer_key string")


def test_a_context_keeps_its_first_row_that_the_question_allows(spark):
    from rankscope.operators.candidates import near_duplicate_pool

    c = qa_rows(spark, [("d", "a_0", 0, "one", "first", "shared", "k1"), ("d", "a_1", 1, "two", "second", "shared", "k2"),
                        ("d", "a_2", 2, "q", "first", "own", "k1"), ("d", "a_3", 3, "z", "zzz", "other", "k3")])
    q = c.where("raw_id = 'a_2'").selectExpr("*", "'q1' as qid", "1 as qno")
    assert near_duplicate_pool(c, q, 1, 0).first().n_pool == 2


def test_too_few_negatives_raise(spark):
    from rankscope.operators.candidates import build_hard_candidates

    c = qa_rows(spark, [("d", f"a_{k}", k, f"ask {k}", f"answer {k}", f"context {k}", f"k{k}") for k in range(4)])
    q = c.where("raw_id = 'a_2'").selectExpr("*", "'q1' as qid", "1 as qno")
    assert build_hard_candidates(c, q, 2, 1).count() == 4
    with pytest.raises(Exception, match="fewer than 4 negatives"):
        build_hard_candidates(c, q, 2, 2).collect()


def test_output_order_and_preview(spark, tmp_path):
    from rankscope.sources.csv import preview, write_csv

    df = spark.createDataFrame([("q2", "x" * 9), ("q1", "y"), ("q3", None)], "qid string, t string").repartition(3)
    write_csv(df, str(tmp_path / "o"), ["qid"])
    lines = [x for f in sorted((tmp_path / "o").glob("part-*")) for x in f.read_text().split()[1:]]
    assert [x[:2] for x in lines] == ["q1", "q2", "q3"]
    assert preview(df.orderBy("qid"), 2, 4) == [{"qid": "q1", "t": "y"}, {"qid": "q2", "t": "xxxx"}]


def test_a_source_of_any_size_is_numbered_by_range(spark):
    from rankscope.operators.corpus import load_qa

    rows = [("a" if k % 10 else "b", "t", f"ask {k % 400}", f"answer {k % 400}", k, 0) for k in range(500)]
    raw = spark.createDataFrame([*rows, (None, "t", "x", "y", 900, 0)],
                                "department string, title string, ask string, answer string, conv_id long, turn long")
    out = load_qa(raw, ["conv_id", "turn"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" not in plan  # no window over a whole source
    got = {(r.canonical_department, r.row_no, r.ask) for r in out.collect()}
    want = {(d, n, f"ask {k}") for d, ks in (("a", [k for k in range(400) if k % 10]), ("b", range(0, 400, 10)))
            for n, k in enumerate(ks)}
    assert got == want | {(None, 0, "x")}


def test_easy_set_moves_texts_and_no_vectors(spark):
    import numpy as np

    from rankscope.operators.candidates import build_easy_candidates
    from rankscope.operators.similarity import _bounded

    rows = [(f"r{k:02d}", f"ask {k % 7}", f"context of {k % 5}", "ab"[k % 2]) for k in range(20)]
    corpus = spark.createDataFrame(rows, "raw_id string, ask string, context string, canonical_department string")
    small = build_easy_candidates(corpus, None, 2, 2, departments=None)
    assert "grams" not in small._jdf.queryExecution().optimizedPlan().toString()  # no vector is shuffled
    spark.conf.set("rankscope.broadcastRows", "0")
    try:
        joined = {r.context_id: r for r in build_easy_candidates(corpus, None, 2, 2, departments=None).collect()}
    finally:
        spark.conf.unset("rankscope.broadcastRows")
    got = {r.context_id: r for r in small.collect()}
    assert got.keys() == joined.keys() and len(got) == 100
    for k, r in got.items():
        assert (r.qid, r.candidate_context) == (joined[k].qid, joined[k].candidate_context)
        assert abs(r.embedding_score - joined[k].embedding_score) < 1e-12
    sizes = [len(x) for x in _bounded(((np.zeros(300), k) for k in range(100)), lambda held: held, 1000)]
    assert sum(sizes) == 100 and max(sizes) == 4  # a worker's batches are bounded by their grams


def test_more_rows_get_more_tasks(spark):
    from rankscope.operators.metrics import listwise_loss, ranking_metrics_from_scores

    rows = [("m", k // 5, k % 5, float((k * 7) % 11), int(k % 5 == 2)) for k in range(400)]
    df = spark.createDataFrame(rows, "method string, qid long, context_id long, score double, label int")
    want = [ranking_metrics_from_scores(df).first(), listwise_loss(df, ["method"]).first()]
    spark.conf.set("rankscope.taskRows", "20")
    try:
        out = [ranking_metrics_from_scores(df), listwise_loss(df, ["method"], rows=400)]
        plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in out]
        assert all("method" in p and ", 20" in p[p.index("RepartitionByExpression"):] for p in plans)  # 20 partitions, not 4
        assert [[round(v, 9) if isinstance(v, float) else v for v in x.first()] for x in out] == [
            [round(v, 9) if isinstance(v, float) else v for v in x] for x in want]
    finally:
        spark.conf.unset("rankscope.taskRows")


def test_weights_of_the_easy_set_are_fitted_on_its_rows_only(spark):
    from rankscope.operators.candidates import build_easy_candidates
    from rankscope.operators.similarity import similarity

    rows = [(f"r{k:02d}", f"ask {k}", f"context of {k}", [None, "a", "b"][k % 3]) for k in range(18)]
    corpus = spark.createDataFrame(rows, "raw_id string, ask string, context string, canonical_department string")
    out = build_easy_candidates(corpus, None, 2, 4, departments=None)
    want = {r.context_id: r.s for r in similarity(out, "context_id", "question", "candidate_context", out="s").collect()}
    got = {r.context_id: r.embedding_score for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
