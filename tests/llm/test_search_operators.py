"""Centroid clustering, hard negatives and decontamination against brute force, with odd rows."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from rankscope.llm import angular, nndescent, threshold, wumanber

from ..conftest import SF_SMALL

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, cluster string"


@pytest.mark.parametrize("name", ["op11_threshold_centroids", "op12_angular_negatives", "op13_wu_manber"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.execute(E.oracle_sql()[name]).df()
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(want) > 10
    assert sorted(map(tuple, got[want.columns].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


# 11 centroid clustering


@pytest.mark.parametrize("k, dim, spread", [(1, 3, 9), (5, 1, 2), (8, 4, 2), (8, 64, 1000), (30, 6, 4)])
def test_threshold_walk_finds_the_nearest(k, dim, spread):
    rng = np.random.default_rng(k)
    centroids = rng.integers(-spread, spread + 1, (k, dim))
    centroids[k // 2] = centroids[0]
    x = rng.integers(-2 * spread, 2 * spread + 1, (400, dim))
    cluster, distance = threshold.nearest(x, centroids)
    every = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (cluster == every.argmin(axis=1)).all()


def test_threshold_walk_stops_early(monkeypatch):
    centroids = np.arange(0, 10_000, 100)[:, None] * np.ones((1, 4), dtype=np.int64)
    steps = []
    real = np.nonzero
    monkeypatch.setattr(threshold.np, "nonzero", lambda a: steps.append(1) or real(a))
    threshold.nearest(centroids[40:60] + 3, centroids)
    assert len(steps) <= 3  # of 100


def lloyd(rows, dim, k, rounds, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in first[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[assign(v)[1]].append(v)
        centroids = [[sum(z) // len(m) for z in zip(*m)] if m else c for m, c in zip(members, centroids)]
    return [(i, *assign(v)[::-1]) for i, v in kept], centroids


def test_clusters_against_lloyd(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-2.5, -0.1, 0.0, 0.3, 1.7]) + rng.randrange(3) for _ in range(3)]) for i in range(90)]
    rows += [(7, rows[7][1]), (7, [9.0, 9.0, 9.0]), (None, [0.5, 0.5, 0.5]), (200, None), (201, [1.0, None, 2.0]),
             (202, [float("nan"), 0.0, 0.0]), (203, [0.0, float("inf"), 0.0]), (204, [1.0]), (205, [])]
    df = spark.createDataFrame([(i, v, None, "x", "y", "z") for i, v in rows], VECTORS).repartition(5)
    for k, rounds in [(8, 10), (3, 1), (200, 2)]:
        want, centroids = lloyd(rows, 3, k, rounds)
        got = threshold.cluster_vectors(df, "vec_id", "embedding", dim=3, k=k, rounds=rounds).collect()
        key = [(r.id is None, r.id or 0, r.cluster, r.distance) for r in got]
        assert sorted(key) == sorted((i is None, i or 0, c, d) for i, c, d in want)
        inertia = {}
        for _, c, d in want:
            inertia[c] = inertia.get(c, 0) + d
        assert all(r.centroid == centroids[r.cluster] and r.cluster_inertia == inertia[r.cluster]
                   and r.inertia == sum(inertia.values()) for r in got)


def test_clusters_of_no_and_of_huge_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    out = threshold.cluster_vectors(none, "vec_id", "embedding")
    assert out.count() == 0 and out.columns[:3] == ["id", "cluster", "distance"]
    huge = spark.createDataFrame([(1, [3e30, 0.0], 1, "", "", "")], VECTORS)
    with pytest.raises(Exception, match="component reaches"):
        threshold.cluster_vectors(huge, "vec_id", "embedding", dim=2)


# 12 hard negatives


def mined(rows, top=5):
    def floors(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]
    kept = [(n, i, label, floors(v)) for n, (i, v, label) in enumerate(rows) if label is not None and floors(v) is not None]
    out = []
    for n, i, label, v in kept:
        if i is None or i % 10:
            continue
        scored = sorted(((-sum(map(int.__mul__, v, w)), j is None, j or 0, m, j, other)
                         for m, j, other, w in kept if m != n and len(w) == len(v)), key=lambda s: s[:4])
        for p in [s for s in scored if s[5] == label][:top]:
            fits = [s for s in scored if s[5] != label and -80 * p[0] <= -100 * s[0] <= -100 * p[0]][:top]
            out += [(i, p[4], r, s[4], -p[0], -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [angular.LEAST, 60])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(angular, "LEAST", least)
    rng = random.Random(8)
    centre = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = []
    for i in range(240):
        c = centre[rng.randrange(6)]
        rows.append((i, [x + rng.gauss(0, 0.2) for x in c], rng.randrange(3)))
    rows += [(500 + k, list(rows[20][1]), k % 3) for k in range(30)]  # ties
    rows += [(20, rows[20][1], 1), (20, rows[21][1], rows[20][2]), (None, rows[30][1], 0), (None, rows[30][1], 1)]
    rows += [(600, [0.0] * 4, 0), (610, [0.0] * 4, 0), (601, [0.0] * 4, 1), (602, None, 1), (603, [1.0, None, 0.0, 0.0], 1),
             (604, [float("nan")] * 4, 1), (605, [float("inf")] * 4, 0), (606, rows[0][1], None), (607, [], 0), (700, [], 0),
             (608, [], 1), (609, [1.0], 0), (710, [1.0], 0), (611, [1.0], 1)]
    df = spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], VECTORS).repartition(3)
    got = angular.hard_negatives(df, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == mined(rows)


def test_score_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    x = np.floor(256 * (centre[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16)) * 0.05)).astype(np.int64)
    x[:40], x[40:60], x[60:70] = x[0], -x[0], 0  # angles of zero and pi, and none
    block = angular.Block(np.arange(600), list(range(600)), rng.integers(0, 3, 600), x)
    scored = 0
    for k in range(0, 600, 7):
        least, most = block.bounds(x[k], slice(None))
        scores = block.x @ x[k]
        assert (least <= scores).all() and (scores <= most).all()
        rows, best, n = block.positives(k, 1, x[k])
        scored += n
        mine = [-int(s) for s in scores[block.of_label(1)][block.number[block.of_label(1)] != k]]
        assert sorted(mine)[:5] == [-s for s in best.tolist()]
    assert scored < 600 / 7 * 200 / 3  # of the rows of the label
    half = block.bounds(np.zeros(16, dtype=np.int64), slice(None))
    assert (half[0] <= 0).all() and (half[1] >= 0).all()


def test_no_and_huge_negatives(spark):
    none = spark.createDataFrame([], VECTORS)
    assert angular.hard_negatives(none, "vec_id", "embedding", "label", F.lit(True)).count() == 0
    some = spark.createDataFrame([(1, [1.0], 1, "", "", ""), (2, [1.0], 2, "", "", "")], VECTORS)
    assert angular.hard_negatives(some, "vec_id", "embedding", "label", F.lit(False)).count() == 0
    huge = spark.createDataFrame([(1, [3e30], 1, "", "", "")], VECTORS)
    with pytest.raises(Exception, match="too large"):
        angular.hard_negatives(huge, "vec_id", "embedding", "label", F.lit(True)).count()


# 13 decontamination


def hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    mine, hit, found = words(text), set(), set()
    for i, t in items:
        of = words(t)
        n = min(10, len(of))
        for a in range(len(of) - n + 1 if of else 0):
            for at in range(len(mine) - n + 1):
                if mine[at:at + n] == of[a:a + n]:
                    hit.update(range(at, at + n))
                    found.update([i] if i is not None else [])
    return len(mine), sorted(hit), sorted(found)


def words_and_items(rng):
    vocabulary = ["a", "b", "c", "Été", "7", "don", "中文字", "x" * 300]

    def line(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "--", "_ ", "\x00"]) for _ in range(n))
    items = [(k, line(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for k in range(3, 25)]
    items = [i for i in items if len(i[1].split()) > 1 or rng.random() < 0.3]
    items += [(40, "a a a a a a a a a a a"), (41, None), (42, "?!"), (None, line(4)), (43, items[-1][1]), (44, items[-1][1]),
              (44, "Z z Z z"), (40, "a a a a a a a a a a a")]
    texts = [line(rng.randrange(60)) for _ in range(40)] + [None, "", "   ", "A" * 5000, "a " * 4000 + "z Z z z z"]
    texts += [line(5) + items[k][1] + line(5) for k in range(len(items) - 7)]
    return items, texts + texts[:6]


@pytest.mark.parametrize("most", [wumanber.MOST_BYTES, 20_000])
def test_decontamination_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(wumanber, "MOST_BYTES", most)
    items, texts = words_and_items(random.Random(4))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, bd_spans string")
    out = wumanber.decontaminate(docs.withColumn("_found", F.lit(1)), benchmark)
    assert out.columns == ["doc_id", "text", "bd_spans", "_found", "bd_n_words", "bd_spans", "bd_items"]
    seen = set()
    for r in out.collect():
        n, hit, found = hits(r.text, items)
        assert r[4] == n and r[6] == found and r[1] == texts[r[0]]
        assert [w for s in r[5] for w in range(s["start"], s["stop"])] == hit
        assert all(a["stop"] < b["start"] for a, b in zip(r[5], r[5][1:]))
        seen.add(r[0])
    assert seen == set(range(len(texts)))


def test_shifts_skip_most_places():
    rng = random.Random(1)
    text = [b"%d" % rng.randrange(5000) for _ in range(8000)]
    table = wumanber.Tables({tuple(text[100:110]): [1]}, 10)
    looked = []

    class Watched(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)
    table.shift = Watched(table.shift)
    assert list(table.search(text)) == [(100, [1])] and len(looked) < 8000 / 7


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = wumanber.decontaminate(docs, none).first()
    assert (row.bd_n_words, row.bd_spans, row.bd_items) == (2, [], [])
    assert wumanber.decontaminate(docs.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        wumanber.decontaminate(docs, none, width=0)


# 5 NN-descent


def test_nn_descent_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(60, 16))
    x = centre[rng.integers(0, 60, 400)] + 0.12 * rng.normal(size=(400, 16))
    x[300:330] = x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    runs = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (3, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        runs.append(sorted(map(tuple, nndescent.near_duplicates(df.repartition(parts)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == runs[1] and len({r[4] for r in runs[0]}) == 1 and 0.97 <= runs[0][0][4] <= 1


def test_nn_descent_ties_lengths_and_names(spark):
    side = 0.19 ** 0.5
    rows = [(1, [3.0, 4.0], "x"), (2, [3.0, 4.0, 0.0], "x"), (3, [0.9, side * (1 - 1e-12)], "x"), (4, [1.0], "x"), (5, [0.0], "x"),
            (6, [], "x"), (None, [3.0, 4.0], "x"), (7, [0.9, side * (1 + 1e-12)], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = {r.id: r for r in nndescent.near_duplicates(df).collect()}
    assert got[4].n_links == 1 and got[3].n_links == 2 and got[7].n_links == 1 and got[4].component_id == 3
    assert got[1].n_links == 2 and got[2].component_id == 1 and got[None].component_id == 1 and not got[None].kept
    assert got[5].n_links == got[6].n_links == 0 and got[5].component_id == 5
