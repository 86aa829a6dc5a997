"""Pairs scored in single precision first: exact results, and few pairs that are added up exactly."""

import numpy as np
import pytest

from rankscope.operators.candidates import order_place
from rankscope.operators.similarity import Best, SparseBlock, sparse_dot


def rows_of(n, random, grams=400, most=60):
    rows = []
    for _ in range(n):
        g = np.sort(random.choice(grams, random.integers(0, most), replace=False)).astype(np.int64)
        w = random.random(len(g)) + 0.01
        rows.append((g, w / np.sqrt((w * w).sum()) if len(g) else w))
    return rows


def packed(rows):
    return (np.concatenate([g for g, _ in rows]), np.concatenate([w for _, w in rows]), np.array([len(g) for g, _ in rows]))


def test_near_scores_lie_within_their_bound():
    random = np.random.default_rng(2)
    rows, asked = rows_of(300, random), rows_of(40, random)
    block = SparseBlock.packed(*packed(rows))
    near, margin = block.near_packed(*packed(asked))
    exact = block.score_packed(*packed(asked))
    assert near.dtype == np.float32 and (np.abs(near - exact) <= margin[:, None]).all()
    wanted = {3: np.array([0, 7]), 5: np.arange(300)}  # few pairs one by one, many by matrices
    for i, scores in block.exact(*packed(asked), wanted).items():
        assert scores == pytest.approx([sparse_dot(*asked[i], *rows[j]) for j in wanted[i].tolist()], abs=1e-9)


@pytest.mark.parametrize("k", [0, 1, 5])
def test_the_best_by_near_scores_are_the_best(k):
    """Copies tie exactly, some rows differ by less than single precision tells, and every third pair is out."""
    random = np.random.default_rng(4)
    rows, asked = rows_of(120, random), rows_of(20, random)
    rows += rows[:30] + [(g, w * (1 - 1e-8)) for g, w in rows[30:60]]
    best, whole, seen = Best(len(asked), k), Best(len(asked), k), []
    for a in range(0, len(rows), 45):
        block, rid = SparseBlock.packed(*packed(rows[a:a + 45])), [f"r{j:03d}" for j in range(a, min(a + 45, len(rows)))]
        out = (np.arange(len(asked))[:, None] + np.arange(a, a + len(rid))) % 3 == 0
        near, margin = block.near_packed(*packed(asked))
        near[out] = -np.inf
        exact = lambda wanted: seen.append(sum(map(len, wanted.values()))) or block.exact(*packed(asked), wanted)  # noqa: E731, B023
        best.offer_near(0, near, margin, exact, rid, np.arange(len(rid)))
        scores = np.round(block.score_packed(*packed(asked)), 10)
        whole.offer(0, np.where(out, -np.inf, scores), rid, np.arange(len(rid)))
    for mine, theirs in zip(best.rows, whole.rows):
        assert [r for *_, r, _ in mine] == [r for *_, r, _ in theirs]
        assert [s for s, *_ in mine] == pytest.approx([s for s, *_ in theirs], abs=1e-9)
    assert sum(seen) < len(rows) * len(asked) / 3


@pytest.mark.parametrize("size", [1, 2, 7, 1000, 450_001, 30_000_000, 50_000_000])
def test_places_of_an_order(size):
    random = np.random.default_rng(size)
    pos, start, stride = random.integers(0, size, 50), random.integers(0, size, 9), []
    while len(stride) < 9:
        one = int(random.integers(0, size)) or 1
        if np.gcd(one, size) == 1:
            stride.append(one)
    pos[0], start[0] = size - 1, 0
    back = np.array([pow(x, -1, size) for x in stride], dtype=np.int64)
    want = [[(int(p) - int(s)) * int(b) % size for p in pos] for s, b in zip(start, back)]
    assert order_place(pos, start, back, size).tolist() == want
