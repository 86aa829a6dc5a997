"""All pairs in blocks: every visitor meets every block once, and disk grows with the texts."""

import os
import random

import pytest

from rankscope.operators import candidates, similarity
from rankscope.operators.candidates import build_hard_candidates
from rankscope.operators.sampling import shuffle_ids
from rankscope.operators.setjoin import similar_weight
from rankscope.operators.similarity import fit_weights, tfidf_packed, topk_texts


def texts_of(n, rng):
    words = ["alpha", "beta", "gamma", "delta", "xyz", "quick", "brown", "0123", "jumps!", "é", "ww", "zebra"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(n)]


def written(spark):
    where = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(where) for f in files)


@pytest.mark.parametrize("broadcast", [True, False])
def test_topk_texts(spark, broadcast):
    rng = random.Random(3)
    texts = texts_of(60, rng)
    docs = spark.createDataFrame([(f"d{k:02d}", t) for k, t in enumerate(texts)], "id string, t string")
    packed = {r.id: dict(zip(r.grams, r.weights)) for r in tfidf_packed(docs, "id", "t").collect()}
    dot = lambda a, b: round(sum(w * packed[b].get(g, 0.0) for g, w in packed[a].items()), 10)
    if not broadcast:
        spark.conf.set("rankscope.broadcastRows", "0")
    try:
        weights = fit_weights(docs.selectExpr("t", "1 AS m"), "t", "m")
        got = topk_texts(docs, docs.withColumnRenamed("id", "other"), "id", "other", "t", weights, 4, exclude_same=True,
                         block_rows=7, visitors=5).collect()
    finally:
        spark.conf.unset("rankscope.broadcastRows")
    best = {(r.id, r.pos): (r.other, r.similarity) for r in got}
    assert len(got) == 60 * 4
    for a in packed:
        want = sorted((-dot(a, b), b) for b in packed if b != a)[:4]
        for pos, (s, b) in enumerate(want, 1):
            assert best[a, pos][1] == pytest.approx(-s, abs=1e-9)
            if broadcast:
                assert best[a, pos][0] == b


def test_topk_texts_writes_texts_not_vectors(spark):
    texts = texts_of(400, random.Random(5))
    docs = spark.createDataFrame([(k, " ".join([t] * 4)) for k, t in enumerate(texts)], "id long, t string").repartition(2)
    weights = fit_weights(docs.selectExpr("t", "1 AS m"), "t", "m")
    before = written(spark)
    best = topk_texts(docs, docs.withColumnRenamed("id", "other"), "id", "other", "t", weights, 3, block_rows=20)
    assert best.count() == 1200
    size = sum(len(t.encode()) * 4 for t in texts)
    assert written(spark) - before < 2.5 * size  # vectors take some ten times as much, and once for each block


def test_a_weight_of_similar_sets(spark):
    rng = random.Random(8)
    sets = [sorted(rng.sample("abcdefghij", rng.randint(0, 9))) for _ in range(70)]
    mine = spark.createDataFrame(list(enumerate(sets[:40])), "id long, items array<string>")
    others = spark.createDataFrame([(k + 1, s) for k, s in enumerate(sets)], "n long, items array<string>")
    got = {r.id: r.n for r in similar_weight(mine, "id", others, "n", "items", 0.6, block_rows=9, visitors=4).collect()}
    near = lambda a, b: bool(a and b) and len(set(a) & set(b)) / len(set(a) | set(b)) > 0.6
    assert got == {i: sum(k + 1 for k, b in enumerate(sets) if near(a, b)) for i, a in enumerate(sets[:40])}
    assert similar_weight(mine, "id", others.limit(0), "n", "items", 0.6).count() == 0
    with pytest.raises(ValueError):
        similar_weight(mine, "id", others, "n", "items", 1.0)


def test_hard_candidates_see_the_pool_once(spark, monkeypatch):
    """Of 120 contexts all but nine are near-duplicates of a question's answer: one pass finds the nine."""
    rows = [("d", k, f"r{k:03d}", f"ask {k % 7}", f"abcdefgh {'abcdefgh'[k % 8]}{k}", f"ask {k % 7} text {k}", f"key {k}") for k in range(111)]
    rows = [(d, k, r, a, "abcdefgh", c, key) for d, k, r, a, _, c, key in rows]
    rows += [("d", k, f"r{k:03d}", f"far {k}", "uvwxyz", f"far text {k}", f"key {k}") for k in range(111, 120)]
    corpus = spark.createDataFrame(rows, "canonical_department string, row_no long, raw_id string, ask string, answer string, "
                                         "context string, answer_key string")
    q = shuffle_ids(corpus, 1, "q")
    passes, cross = [], candidates.cross_blocks
    monkeypatch.setattr(candidates, "cross_blocks", lambda *a, **b: passes.append(1) or cross(*a, **b))
    monkeypatch.setattr(similarity, "visit_blocks", None)
    out = build_hard_candidates(corpus, q, hard=7, random=2, seed=1).collect()
    assert len(passes) == 1 and len(out) == 1200
    near = {f"r{k:03d}" for k in range(111)}
    asked = {r.qid: r.raw_id for r in q.collect()}
    for r in out:
        if asked[r.qid] in near and r.label == 0:
            assert r.candidate_context.startswith("far")
