"""Streaming evaluation of arriving score files and CSV helpers."""

import tempfile

import pytest
from pyspark.sql import functions as F

from rankscope.operators.metrics import evaluate_methods
from rankscope.operators.ranking import rank_scores
from rankscope.sources.csv import head_rows, method_files, positive_mask, write_csv
from rankscope.streaming import evaluate_score_stream


def test_stream_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="rankscope-stream-")
    cand = spark.createDataFrame([("a", "1", 1), ("a", "2", 0), ("b", "1", 0), ("b", "2", 1)],
                                 "qid string, context_id string, label int")
    raw = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.1), ("b", "1", 0.8), ("b", "2", 0.2)],
                                "qid string, context_id string, score double")
    sc = rank_scores(raw, "m1")
    write_csv(sc, f"{root}/scores/m1")
    q = evaluate_score_stream(spark, f"{root}/scores/m1", cand, f"{root}/out", f"{root}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{root}/out").drop("batch_id").collect()
    want = evaluate_methods(sc, cand).collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]


def test_csv_helpers(spark):
    assert method_files([" a = x ", "b=y"]) == {"a": "x", "b": "y"}
    with pytest.raises(ValueError):
        method_files(["nope"])
    df = spark.createDataFrame([("q2", "positive", "c1"), ("q1", "hard", "c2"), ("q1", "gold", "c0")],
                               "qid string, source_type string, context_id string")
    assert [r.context_id for r in head_rows(df, 2).collect()] == ["c0", "c2"]
    assert [r.p for r in df.select(positive_mask(df).alias("p")).collect()] == [True, False, True]
    with pytest.raises(ValueError):
        head_rows(df, 0)


def test_read_csv_auto_gb18030_and_utf8_bom(spark):
    from rankscope.sources.csv import read_csv_auto

    root = tempfile.mkdtemp(prefix="rankscope-csv-")
    text = "department,title,ask,answer\n儿科,标题,\"孩子发烧, 怎么办\",多喝水\n肿瘤,,NA,答\n"
    with open(f"{root}/gb.csv", "wb") as fh:
        fh.write(text.encode("gb18030"))
    with open(f"{root}/bom.csv", "wb") as fh:
        fh.write(b"\xef\xbb\xbf" + text.encode("utf-8"))
    for name in ("gb.csv", "bom.csv"):
        rows = read_csv_auto(spark, f"{root}/{name}").collect()
        assert rows[0].asDict() == {"department": "儿科", "title": "标题", "ask": "孩子发烧, 怎么办", "answer": "多喝水"}
        assert rows[1].ask is None and rows[1].title is None
