"""Loaders, typed reads, the error-analysis job, the score store and scorers over subsets."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankscope.jobs import CASES, SUMMARY, error_analysis, is_complete
from rankscope.operators.compare import method_stats_long
from rankscope.operators.metrics import evaluate_methods
from rankscope.operators.ranking import rank_scores
from rankscope.operators.scoring import score_pairs
from rankscope.operators.sequences import encode_pairs, ids_by_code_point
from rankscope.sources.csv import context_column, load_candidates, method_files, read_csv_auto, write_csv
from rankscope.sources.store import read_candidates, read_scores, write_store

COLUMNS = ["qid", "question", "context_id", "candidate_context", "label", "department", "source_type", "embedding_score"]


def candidate_rows(bad=None):
    rows = []
    for q in range(12):
        for c in range(4):
            rows.append([f"q{q}", f"ask {q}", f"c{q}{c}", "line one\nline \"two\"" if c == 2 else f"text {c}", int(c == q % 4),
                         "d", "positive" if c == q % 4 else "hard_negative", 0.5 - c / 10])
    if bad == "two":
        rows[1][4] = 1
    if bad == "none":
        rows[0][4] = 0
    return rows


def write_rows(path, rows, columns=COLUMNS, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f).writerows([columns, *rows])
    return str(path)


def test_candidate_loader_checks_positives(spark, tmp_path):
    df, context = load_candidates(spark, write_rows(tmp_path / "good.csv", candidate_rows()))
    assert context == "candidate_context" and df.where("is_positive").count() == 12 and df.count() == 48
    for bad, rule in (("two", "positives_not_one"), ("none", "no_positive")):
        with pytest.raises(ValueError, match=rule):
            load_candidates(spark, write_rows(tmp_path / f"{bad}.csv", candidate_rows(bad)))
    with pytest.raises(ValueError, match="no rows"):
        load_candidates(spark, write_rows(tmp_path / "empty.csv", []))
    with pytest.raises(ValueError, match="missing columns"):
        load_candidates(spark, write_rows(tmp_path / "short.csv", [["q1"]], ["qid"]))


def test_context_column_and_method_files(spark):
    assert context_column(spark.createDataFrame([], "document string, passage string, x int")) == "passage"
    with pytest.raises(ValueError):
        context_column(spark.createDataFrame([], "x int"))
    assert method_files([" a = b=c ", "m=  p q "]) == {"a": "b=c", "m": "p q"}
    for bad in ("x", "=p", "m= ", " = "):
        with pytest.raises(ValueError, match="method=path"):
            method_files(["ok=1", bad])


def test_typed_read(spark, tmp_path):
    rows = [["1", "1.5", "true", "x", "", "9223372036854775808", " 7"], ["-3", "NaN", "False", "1", "", "1", "8"],
            ["", "2e3", "", "y", "NA", "2", "9"]]
    df = read_csv_auto(spark, write_rows(tmp_path / "t.csv", rows, list("abcdefg")), typed=True)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string", "f": "double",
                               "g": "bigint"}
    got = df.collect()
    assert [r.a for r in got] == [1, -3, None] and [r.b for r in got] == [1.5, None, 2000.0] and got[1].c is False


def test_files_of_two_encodings_and_split_files(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write_rows(folder / "a.csv", [["1", "中文"], ["2", "two\nlines"]], ["n", "t"], "gb18030")
    write_rows(folder / "b.csv", [["3", "ü"]], ["n", "t"])
    write_rows(folder / "c.csv", [["4", "a\nb"]], ["n", "t"], "utf-8-sig")
    got = {r.n: r.t for r in read_csv_auto(spark, str(folder)).collect()}
    assert got == {"1": "中文", "2": "two\nlines", "3": "ü", "4": "a\nb"}
    big = write_rows(tmp_path / "big.csv", [[str(k), f"é{k}"] for k in range(4000)], ["n", "t"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_csv_auto(spark, big)
        assert df.rdd.getNumPartitions() > 3 and df.count() == 4000 and df.where("t = 'é' || n").count() == 4000
        assert [r.n for r in read_csv_auto(spark, big, nrows=3).collect()] == ["0", "1", "2"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_error_analysis_job(spark, tmp_path):
    rng = random.Random(1)
    path = write_rows(tmp_path / "candidates.csv", candidate_rows())
    keys = [(r[0], r[2]) for r in candidate_rows()]
    files = {}
    for m in ("embedding_baseline", "bce"):
        raw = spark.createDataFrame([(q, c, rng.random()) for q, c in keys], "qid string, context_id string, score double")
        files[m] = str(tmp_path / m)
        write_csv(rank_scores(raw, m), files[m])
    out = str(tmp_path / "out")
    cases, summary = error_analysis(spark, path, files | {"absent": str(tmp_path / "no")}, out, max_context_chars=6)
    assert is_complete(spark, out)
    back = read_csv_auto(spark, f"{out}/{CASES}", typed=True)
    assert back.columns == cases.columns and back.count() == cases.count() > 0
    assert {"qid", "case_type", "question", "positive_context_id", "positive_context", "bce_top1_context"} <= set(back.columns)
    assert all(len(r.positive_context) <= 9 for r in back.collect())
    totals = {(r.section, r.item): r["count"] for r in read_csv_auto(spark, f"{out}/{SUMMARY}", typed=True).collect()}
    assert totals == {(r.section, r.item): r["count"] for r in summary.collect()}
    assert sum(n for (s, i), n in totals.items() if s == "method_rank" and i in (
        "bce_rank_1", "bce_rank_2_to_3", "bce_rank_4_to_5", "bce_rank_6_plus_or_missing")) == 12
    bad = str(tmp_path / "bad")
    with pytest.raises(ValueError, match="positives_not_one"):
        error_analysis(spark, write_rows(tmp_path / "two.csv", candidate_rows("two")), files, bad)
    assert not is_complete(spark, bad)


def test_first_positive_by_load_order(spark):
    cand = spark.createDataFrame([("q", "a", True, 2), ("q", "b", True, 1), ("q", "c", False, 3)],
                                 "qid string, context_id string, is_positive boolean, line int")
    scores = rank_scores(spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0), ("q", "c", 2.0)],
                                               "qid string, context_id string, score double"), "m")
    assert method_stats_long(cand, scores, ["m"]).first().positive_rank == 1
    assert method_stats_long(cand, scores, ["m"], order=["line"]).first().positive_rank == 3


def test_store_needs_no_exchange_and_prunes(spark, tmp_path):
    rng = random.Random(2)
    raw = spark.createDataFrame([(f"q{q}", f"c{c}", m, rng.random(), 0.0) for q in range(60) for c in range(5) for m in "xyz"],
                                "qid string, context_id string, method string, score double, latency_ms double")
    cand = spark.createDataFrame([(f"q{q}", f"c{c}", int(c == q % 5)) for q in range(60) for c in range(5)],
                                 "qid string, context_id string, label int")
    scores = rank_scores(raw)
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        write_store(scores, cand, "teststore", buckets=4)
        stored, known = read_scores(spark, "teststore"), read_candidates(spark, "teststore")
        joined = stored.join(known.select("qid", "context_id", "label"), ["qid", "context_id"])
        plan = joined.groupBy("method", "qid").agg(F.min("rank"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        want = sorted(map(tuple, evaluate_methods(scores, cand).collect()))
        assert sorted(map(tuple, evaluate_methods(stored, known, dealt=True).collect())) == want
        one = read_scores(spark, "teststore", ["y"])
        assert "PartitionFilters: [isnotnull(method" in one._jdf.queryExecution().executedPlan().toString().replace("method IN", "isnotnull(method")
        assert one.count() == 300
    finally:
        for t in ("scores", "candidates"):
            spark.sql(f"DROP TABLE IF EXISTS teststore_{t}")
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_groups_evaluate_alike(spark):
    rng = random.Random(5)
    raw = spark.createDataFrame([("hot" if k % 3 else f"q{k % 7}", f"c{k:03d}", rng.random()) for k in range(300)],
                                "qid string, context_id string, score double")
    cand = raw.select("qid", "context_id", (F.col("score") > 0.8).cast("int").alias("label"))
    scores = rank_scores(raw, "m")
    want = evaluate_methods(scores, cand).collect()
    spark.conf.set("rankscope.hotGroupRows", "20")
    try:
        assert evaluate_methods(scores, cand).collect() == want
    finally:
        spark.conf.unset("rankscope.hotGroupRows")
    with pytest.raises(ValueError, match="no score row"):
        evaluate_methods(scores, cand.withColumn("qid", F.lit("other")))


@pytest.mark.parametrize("batch_size, records", [(1, 10_000), (7, 5), (64, 100)])
def test_scores_do_not_depend_on_batches(spark, batch_size, records):
    rng = random.Random(3)
    rows = [(f"q{k % 9}", f"c{k:03d}", "x" * rng.randrange(30), "y" * rng.randrange(30)) for k in range(150)]
    pairs = spark.createDataFrame(rows, "qid string, context_id string, question string, candidate_context string")
    split = spark.createDataFrame([(f"q{k}", "test" if k < 3 else "train") for k in range(9)], "qid string, split string")

    def factory():
        def score(qs, cs):
            assert len(qs) == len(cs) <= batch_size
            return np.array([[0.0, len(q) - len(c)] for q, c in zip(qs, cs)])
        return score

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        got = {(r.qid, r.context_id): r.score for r in score_pairs(pairs, factory, "m", batch_size).collect()}
        assert got == {(q, c): len(a) - len(b) for q, c, a, b in rows}
        test = score_pairs(pairs, factory, "m", batch_size, split=split, subset="test").collect()
        assert {r.qid for r in test} == {"q0", "q1", "q2"} and len(test) == sum(r[0] in ("q0", "q1", "q2") for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError):
        score_pairs(pairs, factory, "m", subset="test")


def test_encoding_by_code_point(spark):
    vocab = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("a", 4), ("é", 5), ("中", 6), ("𝔘", 7)], "ch string, id int")
    df = spark.createDataFrame([("q", "c", "aé?", "中𝔘 x"), ("q", "c", None, ""), ("q", "d", "a" * 20, "é" * 20)],
                               "qid string, context_id string, question string, candidate_context string")
    rows = encode_pairs(df, vocab, 10).collect()
    assert rows[0].input_ids == [2, 4, 5, 1, 3, 6, 7, 1, 1, 3] and rows[0].token_type_ids == [0] * 5 + [1] * 5
    assert rows[1].input_ids == [2, 3, 3] + [0] * 7 and rows[1].attention_mask == [1] * 3 + [0] * 7
    assert rows[2].input_ids == [2, 4, 4, 4, 4, 3, 5, 5, 5, 3]
    plan = encode_pairs(df, vocab, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
    with pytest.raises(ValueError):
        ids_by_code_point(spark.createDataFrame([("ab", 4)], "ch string, id int"))


def test_folders_by_value_are_written_in_one_job(spark, tmp_path):
    from rankscope.sources.csv import load_scores, write_csv_by

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("1", f"c{k}", float(k), k, m, 0.0) for m in ("a", "b", "x") for k in (1, 2, 3)],
                                 "qid string, context_id string, score double, rank int, method string, latency_ms double")
    files = write_csv_by(rows.mapInArrow(count, rows.schema), str(tmp_path / "s"), "method", ["a", "b", "none"])
    assert seen.value == 9 and list(files) == ["a", "b", "none"]
    back = load_scores(spark, files)
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(tuple(r) for r in rows.where("method <> 'x'").collect())
