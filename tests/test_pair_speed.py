"""Pairs of texts: what a task computes once for several pairs, and how pairs and rows of a fit are dealt over tasks."""

import numpy as np
from pyspark.sql import functions as F

from rankscope.functions import text as T
from rankscope.operators import models
from rankscope.operators.candidates import build_easy_candidates
from rankscope.operators.scoring import build_features
from rankscope.operators.similarity import Lookup, distinct, fit_weights, gram_ids, gram_ids_of, sparse_dot, text_similarity, tfidf_text

ODD = [None, "", "a", "!?", "ab", "aab ab", "中文 字a", "😀a😀b", "x" * 3000, "Über 9 straße", "a\nb", "中"]


def corpus(spark, n=60):
    rows = [("even" if k % 3 else "odd", f"r{k:03d}", f"question {k} {'ab' * (k % 7)}", f"context {k % 11} {'cd ' * (k % 5)}{k}")
            for k in range(n)]
    return spark.createDataFrame(rows, "canonical_department string, raw_id string, ask string, context string")


def test_overlap_makes_no_arrays_of_strings(spark, capsys):
    pairs = spark.createDataFrame([(a, b) for a in ODD for b in ODD], "a string, b string")
    got = pairs.select(T.keyword_overlap("a", "b").alias("now"), T.set_jaccard(T.char_bigrams("a"), T.char_bigrams("b")).alias("was"))
    assert got.where("now is null or now <> was").count() == 0
    cand = pairs.selectExpr("'q' as qid", "'c' as context_id", "1 as label", "0.5 as embedding_score", "a as question",
                            "b as candidate_context", "'x' as department", "'x' as question_department")
    build_features(cand).explain()
    assert "regexp_extract_all" not in capsys.readouterr().out


def test_grams_of_several_texts_at_once():
    texts = [t or "" for t in ODD] + ["y" * 70_000, "ab"]
    for size in ((2, 4), (1, 3), (3, 3)):
        for text, ids in zip(texts, gram_ids_of(texts, *size), strict=True):
            assert np.array_equal(ids, gram_ids(text, *size))
            for mine, theirs in zip(distinct(ids), np.unique(ids, return_counts=True)):
                assert np.array_equal(mine, theirs)


def test_lookup_and_dot():
    random = np.random.default_rng(1)
    for n in (1, 2, 1000, 30_000):
        grams = np.unique(random.integers(-2**63, 2**63 - 1, n))
        idf = random.random(len(grams))
        some, more = (np.sort(random.choice(grams, size, False)) for size in (min(n, 50), min(n, 700)))
        assert np.array_equal(Lookup((grams, idf))[some], idf[np.searchsorted(grams, some)])
        w, v = random.random(len(some)), random.random(len(more))
        _, i, j = np.intersect1d(some, more, assume_unique=True, return_indices=True)
        assert sparse_dot(some, w, more, v) == sparse_dot(more, v, some, w) == float(np.dot(w[i], v[j]))
    assert sparse_dot(grams[:0], idf[:0], grams, idf) == 0.0


def test_similarity_of_prepared_and_other_texts(spark):
    pairs = spark.createDataFrame([(f"{i}-{j}", a, b) for i, a in enumerate(ODD) for j, b in enumerate(ODD)], "k string, a string, b string")
    texts = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct().where("t is not null").withColumn("m", F.lit(1))
    weights = fit_weights(texts, "t", "m")
    plain = {r.k: r.similarity for r in text_similarity(pairs, "k", "a", "b", weights).collect()}
    ready = text_similarity(pairs.withColumn("_rt", tfidf_text("b")), "k", "a", "b", weights)
    assert ready.columns == ["k", "a", "b", "similarity"]
    assert {r.k: r.similarity for r in ready.collect()} == plain
    assert abs(plain["8-8"] - 1) < 1e-9 and plain["0-0"] == 0


def test_pairs_are_dealt_by_rows_not_bytes(spark):
    def rows():
        return build_easy_candidates(corpus(spark), None, 4, 5, 42, ("even", "odd"))

    whole = rows()
    spark.conf.set("rankscope.pairRows", "50")
    try:
        dealt = rows()
        assert dealt.rdd.getNumPartitions() >= 600 // 50
    finally:
        spark.conf.unset("rankscope.pairRows")
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))


def test_rows_of_a_fit_are_dealt_by_rows(spark, monkeypatch):
    cand = build_easy_candidates(corpus(spark), None, 4, 5, 42, ("even", "odd"))
    parts = []

    def seen(df):
        out = materialize(df)
        parts.append((set(out.columns), out.rdd.getNumPartitions()))
        return out

    materialize = models.materialize
    monkeypatch.setattr(models, "materialize", seen)
    spark.conf.set("rankscope.fitRows", "50")
    try:
        scores, metrics = models.train_lightweight(cand, "rf", 0.25, 42, "all")
    finally:
        spark.conf.unset("rankscope.fitRows")
    assert [n for columns, n in parts if {"split", "label"} <= columns] == [12]
    assert scores.count() == 600 and scores.where("score between 0 and 1").count() == 600
    assert metrics.first().num_train_qids == 45
