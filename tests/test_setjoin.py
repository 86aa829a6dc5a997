"""Set-similarity join and the pools of the hard set, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rankscope.operators import candidates
from rankscope.operators.candidates import build_hard_candidates, near_duplicate_pool, pool_counts
from rankscope.operators.sampling import shuffle_ids
from rankscope.operators.setjoin import similar_sets
from rankscope.operators.similarity import gram_counts, gram_ids, packed_dot, tfidf_packed


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


@pytest.mark.parametrize("threshold", [0.29, 0.5, 0.8])
def test_similar_sets(spark, threshold):
    rng = random.Random(6)
    sets = {}
    for k in range(150):
        base = list(sets[rng.randrange(k)]) if k and rng.random() < 0.5 else rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 14))
        if base and rng.random() < 0.6:
            base[rng.randrange(len(base))] = rng.choice("abcdefghijklmnopqrstuvwxyz0123")
        sets[k] = sorted(set(base) | ({"z"} if k % 3 else set()))  # a hot item
    sets |= {200: [], 201: None, 202: ["z"], 203: ["z"]}
    df = spark.createDataFrame([(k, v, "x") for k, v in sets.items()], "id long, items array<string>, prefix string")
    got = {(r.left_key, r.right_key): r.jaccard for r in similar_sets(df, "id", "items", threshold).collect()}
    want = {(a, b): jaccard(sets[a], sets[b]) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) > threshold}
    assert got == want and len(want) > 20
    assert similar_sets(df.limit(0), "id", "items", threshold).count() == 0
    with pytest.raises(ValueError):
        similar_sets(df, "id", "items", 1.0)


def corpus_of(spark, rng, n):
    words = ["alpha", "beta", "gamma delta", "xyz", "quick", "brown fox", "0123", "jumps!", "é", "ww"]
    rows = []
    for k in range(n):
        answer = " ".join(rng.sample(words, rng.randint(1, 4)))
        ask = " ".join(rng.choices(words, k=rng.randint(1, 3)))
        context = rng.choice(["shared one", "shared two", f"{ask} {answer}", f"{ask} {answer}"])
        rows.append((rng.choice(["d1", "d2"]), k, f"r{k:03d}", ask, answer, context, answer))
    rows += [("d1", n, f"r{n:03d}", "same", "words", "shared one", "words"), ("d2", n + 1, f"r{n + 1:03d}", "s", "words", "s words", "words")]
    return spark.createDataFrame(rows, "canonical_department string, row_no long, raw_id string, ask string, answer string, "
                                       "context string, answer_key string")


def brute_pool(rows, q):
    out = {}
    for r in sorted(rows, key=lambda r: (r.canonical_department, r.row_no, r.raw_id)):
        if r.raw_id != q.raw_id and r.context != q.context and r.answer_key != q.answer_key and r.context not in out:
            out[r.context] = r
    return list(out.values())


def chars(x):
    return set(x.lower()) - {" "}


def test_pool_counts(spark):
    corpus = corpus_of(spark, random.Random(2), 70)
    q = shuffle_ids(corpus, 1, "q")
    rows, asked = corpus.collect(), {r.qid: r for r in q.collect()}
    got = {r.qid: (r.n_pool, r.n_near) for r in pool_counts(corpus, q, 0.8).collect()}
    for qid, r in asked.items():
        pool = brute_pool(rows, r)
        assert got[qid] == (len(pool), sum(jaccard(chars(r.answer), chars(p.answer)) > 0.8 for p in pool)), qid
    plan = near_duplicate_pool(corpus, q)._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("looked, growth", [(4, 4), (1, 2)])
def test_hard_candidates(spark, monkeypatch, looked, growth):
    monkeypatch.setattr(candidates, "LOOKED", looked)
    monkeypatch.setattr(candidates, "GROWTH", growth)
    corpus = corpus_of(spark, random.Random(4), 60)
    q = shuffle_ids(corpus, 1, "q")
    rows = {r.raw_id: r for r in corpus.collect()}
    asked = {r.qid: r for r in q.collect()}
    out = build_hard_candidates(corpus, q, hard=4, random=3, seed=1).collect()
    by_q = {}
    for r in out:
        by_q.setdefault(r.qid, []).append(r)
    assert by_q.keys() == asked.keys()
    for qid, mine in by_q.items():
        me = asked[qid]
        assert [sum(r.source_type == s for r in mine) for s in candidates.HARD_SOURCE_TYPES] == [1, 4, 3]
        pool = brute_pool(rows.values(), me)
        far = [p for p in pool if jaccard(chars(me.answer), chars(p.answer)) <= 0.8]
        pool = far if len(far) >= 7 else pool
        contexts = [r.candidate_context for r in mine if r.label == 0]
        assert len(set(contexts)) == 7 and set(contexts) <= {p.context for p in pool}
        hard = sorted((r.embedding_score for r in mine if r.source_type == "embedding_hard_negative"), reverse=True)
        assert all(r.embedding_score <= hard[-1] + 1e-9 for r in mine if r.source_type == "random_negative")
    ids = sorted(r.context_id for r in out)
    assert len(set(ids)) == len(ids)
    with pytest.raises(Exception, match="fewer than"):
        build_hard_candidates(corpus, q, hard=4000, random=3).collect()


def test_packed_vectors_by_broadcast_and_by_join(spark):
    texts = ["the cat sat", "the cat", "", "a", "ab", "Ünïcode  𝔘 text", "the cat sat"]
    docs = spark.createDataFrame([(k, t, 2) for k, t in enumerate(texts)], "id long, t string, m long")
    ids = gram_ids("abab")
    assert len(ids) == 3 + 2 + 1 and len(set(ids.tolist())) == 2 + 2 + 1 and len(gram_ids("a")) == 0
    counts = {r.k: (len(r.grams), sum(r.tf)) for r in gram_counts(docs, "id", "t").collect()}
    assert counts[2] == (0, 0) and counts[4] == (1, 1) and counts[1] == (6 + 5 + 4, 15)
    small = {r.id: (r.grams, r.weights) for r in tfidf_packed(docs, "id", "t", "m").collect()}
    spark.conf.set("rankscope.broadcastRows", "0")
    try:
        joined = {r.id: (r.grams, r.weights) for r in tfidf_packed(docs, "id", "t", "m").collect()}
    finally:
        spark.conf.unset("rankscope.broadcastRows")
    assert small.keys() == joined.keys() == set(range(7))
    for k, (grams, weights) in small.items():
        assert grams == joined[k][0] and weights == pytest.approx(joined[k][1])
        assert not weights or sum(w * w for w in weights) == pytest.approx(1)
    pairs = spark.createDataFrame([(0, 0, 6), (1, 0, 2), (2, 0, 3)], "p long, a long, b long")
    dots = {r.p: r.d for r in packed_dot(pairs, tfidf_packed(docs, "id", "t"), "id", "p", "a", "b", "d").collect()}
    assert dots == {0: pytest.approx(1), 1: 0, 2: 0}
