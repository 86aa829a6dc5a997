"""What queries write grows with the rows: visits, texts, scores and candidates."""

import csv
import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from rankscope import jobs
from rankscope.operators import candidates, corpus, scan, setjoin, similarity
from rankscope.operators.candidates import char_array, char_text, near_duplicate_pool, pool_features
from rankscope.operators.similarity import topk_dense
from rankscope.operators.ranking import total_and_most
from rankscope.plans import catalog, hard_queries, io_queries


@pytest.mark.parametrize("exclude_same", [True, False])
def test_dense_visits_are_not_written(spark, monkeypatch, exclude_same):
    """Of 600 vectors without structure nearly every question sees each of some 60 blocks."""
    random = np.random.default_rng(6)
    v = random.normal(size=(600, 64)).astype(np.float32)
    v[500:] = v[:100]  # ties
    ids = [*range(599), 0]  # one of them twice
    rows = spark.createDataFrame(list(zip(ids, v.tolist())), "id long, v array<float>").repartition(3).localCheckpoint()
    kept, materialize = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df: kept.append(materialize(df)) or kept[-1])
    got = topk_dense(rows, rows.withColumnRenamed("id", "other"), "id", "other", "v", 5, exclude_same=exclude_same,
                     block_rows=10, visitors=50).collect()
    assert max(df.count() for df in kept) < 10_000  # some 48,000 visits
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 10)
    best = {(r.id, r.pos): (r.other, r.similarity) for r in got}
    assert len(got) == 599 * 5
    for one in range(599):
        want = sorted((-scores[i, j], ids[j]) for i in range(600) if ids[i] == one for j in range(600)
                      if not (exclude_same and ids[j] == one))[:5]
        assert [best[one, p + 1][0] for p in range(5)] == [j for _, j in want]
        assert [best[one, p + 1][1] for p in range(5)] == pytest.approx([-s for s, _ in want], abs=1e-9)


def documents(spark, n=120, filler=4000):
    """Documents of a few long texts, some in two languages, with equal openings, or null."""
    texts = [f"ask {k % 9} {'opening ' * 160}{'xyz' * (k % 5)} {k % 40} {'w' * filler}" for k in range(n)]
    rows = [(k, texts[k] if k % 17 else None, ["en", "fr", None][k % 3], f"src{k % 4}") for k in range(n)]
    return spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string, source string")


def test_near_duplicate_pool_moves_no_texts(spark, tmp_path, monkeypatch):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for module in (candidates, corpus, hard_queries, scan, setjoin):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", lambda df, f=module.materialize: kept.append(f(df)) or kept[-1])
    got = sorted(map(tuple, hard_queries.q_near_duplicate_pool(spark, str(tmp_path)).collect()))
    longest = [max((df.agg(F.max(F.length(c))).first()[0] or 0) for c, t in df.dtypes if t == "string")
               for df in kept if "string" in dict(df.dtypes).values()]
    assert len(longest) > 3 and max(longest) < 100
    loaded, q = hard_queries.hard_inputs(spark, str(tmp_path))  # the same from whole texts
    want = near_duplicate_pool(loaded, q, hard_queries.HARD, hard_queries.RANDOM, hard_queries.MAX_JACCARD)
    assert got == sorted(map(tuple, want.collect())) and len(got) == q.count() > 40


def test_features_in_the_place_of_texts(spark, tmp_path):
    documents(spark, filler=5).write.parquet(f"{tmp_path}/documents.parquet")
    whole = hard_queries.documents_corpus(spark, str(tmp_path))
    slim = hard_queries.documents_corpus(spark, str(tmp_path), pool_features())
    assert slim.columns == ["canonical_department", "raw_id", "row_no", "ctx", "key", "chars"]
    want = whole.select("canonical_department", "raw_id", "row_no", F.md5("context"), F.md5("answer_key"), char_text("answer"))
    assert sorted(map(str, slim.collect())) == sorted(str(r) for r in want.toDF(*slim.columns).collect())


def test_characters_as_a_text(spark):
    answers = ["", None, "Banana  b", "é中中a", "😀a😀", "\"\\[x]"]
    rows = spark.createDataFrame([(a,) for a in answers], "a string").select("a", char_text("a").alias("t"))
    got = {r.a: sorted(r.x) for r in rows.select("a", char_array("t").alias("x")).collect()}
    assert got == {a: sorted(set((a or "").lower()) - {" "}) for a in answers}


def line_items(spark, path, orders=300):
    """Lines of some orders, with repeated keys, null scores and one null order."""
    rows = [(o if o else None, 1 + (o * k) % 5, "RAN"[(o + k) % 3], float(o * 7 % 50 + k) if (o + k) % 11 else None, float(k % 4),
             (o * k % 9) / 10) for o in range(orders) for k in range(o % 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_extendedprice double, "
                                "l_quantity double, l_discount double").write.parquet(f"{path}/lineitem.parquet")


def hot_and_dealt(spark, query, path):
    """The rows of a query over lines that are dealt by order, and over the same with every order taken for a hot one."""
    dealt = query(spark, path)
    rows = sorted(map(str, dealt.collect()))
    spark.conf.set("rankscope.hotGroupRows", "3")
    try:
        return dealt, rows, sorted(map(str, query(spark, path).collect()))
    finally:
        spark.conf.unset("rankscope.hotGroupRows")


def test_lines_are_dealt_once(spark, tmp_path):
    line_items(spark, tmp_path)
    for name in ("evaluate_methods", "method_stats_wide"):
        dealt, rows, hot = hot_and_dealt(spark, catalog.queries()[name], str(tmp_path))
        plan = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Exchange hashpartitioning(l_orderkey" in plan and "Exchange hashpartitioning(qid" not in plan
        assert not any(f"Exchange hashpartitioning({c}" in plan and f"qid#" in line for c in ("method", "context_id")
                       for line in plan.splitlines() if f"Exchange hashpartitioning({c}" in line)
        assert len(rows) >= 3 and rows == hot


def test_groups_are_counted_by_buckets_first(spark):
    rows = spark.range(20_000).selectExpr("id % 5000 AS a", "'x' AS b")
    total, most = total_and_most(rows, ["a", "b"], 100)
    assert total == 20_000 and 4 <= most <= 100
    assert total_and_most(rows, ["a", "b"], 3) == (20_000, 4)
    assert total_and_most(rows.limit(0), ["a", "b"], 3) == (0, 0)


@pytest.mark.parametrize("name", ["error_analysis_cases", "error_analysis_summary"])
def test_analysis_keeps_statistics_and_packs_files(spark, tmp_path, monkeypatch, name):
    line_items(spark, tmp_path, 150)
    kept, materialize, roots, analysis = [], jobs.materialize, [], io_queries.error_analysis
    monkeypatch.setattr(jobs, "materialize", lambda df: kept.append(materialize(df)) or kept[-1])
    monkeypatch.setattr(io_queries, "error_analysis", lambda *a, **b: roots.append(os.path.dirname(a[1])) or analysis(*a, **b))
    _, rows, hot = hot_and_dealt(spark, catalog.queries()[name], str(tmp_path))
    assert len(rows) > 5 and rows == hot
    for df in kept:  # neither scores nor the texts of cases
        assert not {"latency_ms", "rank", "question", "positive_context"} & set(df.columns)
    for root in roots:
        files = [f for d, _, names in os.walk(root.removeprefix("file:")) if "_COMPLETE" not in d for f in names
                 if f.startswith("part-")]
        assert len(files) > 4 and all(f.endswith(".csv.gz") for f in files)


def test_a_bad_score_without_a_rank_is_still_told(spark, tmp_path):
    def written(name, rows):
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f).writerows(rows)
        return str(tmp_path / name)

    cand = written("c.csv", [["qid", "question", "context_id", "candidate_context", "label", "department", "source_type", "embedding_score"],
                             ["q1", "x", "c1", "t", "1", "d", "positive", "0.5"]])
    scores = written("s.csv", [["qid", "context_id", "score", "rank", "method", "latency_ms"],
                               ["q1", "c1", "0.5", "1", "m", "0"], ["q9", "c9", "high", "", "m", "0"]])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        jobs.error_analysis(spark, cand, {"m": scores}, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")
