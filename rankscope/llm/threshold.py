"""Centroid clustering with nearest centroids found by the threshold algorithm.

Vectors and centroids are integers, so that every sum, distance and tie is
exact.  For each dimension the centroids stand in a list sorted by their value
there.  A vector walks all lists outward from its own value, a step in every
dimension at a time; a centroid met for the first time gets its exact distance.
A centroid not met yet is at least as far away, in each dimension, as the
frontier of the walk, so the walk ends when the sum of the squared frontier
distances strictly exceeds the best exact distance: an equal one could still
hide a centroid of a smaller number.

A round is one pass over the vectors: each task adds up its vectors by cluster,
Spark adds up the tasks' sums, and only the centroids (k rows) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankscope.llm.common import materialize

DIM = 64
K = 8
ROUNDS = 10
SCALE = 1024.0
#: Components of vectors walked at a time.
_STEP = 1 << 18


def limit(dim: int) -> int:
    """Bound of integer components below which a squared distance over ``dim`` dimensions fits a long."""
    return math.isqrt((1 << 61) // dim)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of ``x``; ties go to the smaller number.  All values are int64."""
    n, dim = x.shape
    k = len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    best, cluster = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
    seen = np.zeros((n, k), dtype=bool)
    right = np.stack([np.searchsorted(values[:, d], x[:, d]) for d in range(dim)], axis=1)
    left = right - 1
    walking, column = np.arange(n), np.arange(dim)
    for _ in range(k):
        at, lo, hi = x[walking], left[walking], right[walking]
        below = np.where(lo >= 0, at - values[lo, column], np.iinfo(np.int64).max)
        above = np.where(hi < k, values[np.minimum(hi, k - 1), column] - at, np.iinfo(np.int64).max)
        down = below <= above
        met = order[np.where(down, lo, np.minimum(hi, k - 1)), column]
        left[walking], right[walking] = lo - down, hi + ~down
        new = np.zeros((len(walking), k), dtype=bool)
        new[np.arange(len(walking))[:, None], met] = True
        new &= ~seen[walking]
        seen[walking] |= new
        row, number = np.nonzero(new)
        distance = ((at[row] - centroids[number]) ** 2).sum(axis=1)
        for c in range(k):  # ascending, so that of equal distances the smaller number stays
            mine = walking[row[number == c]]
            d = distance[number == c]
            closer = (d < best[mine]) | ((d == best[mine]) & (c < cluster[mine]))
            best[mine[closer]], cluster[mine[closer]] = d[closer], c
        frontier = np.where(down, below, above)
        walking = walking[(frontier ** 2).sum(axis=1) <= best[walking]]
        if not len(walking):
            break
    return cluster, best


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dim)
    step = max(1, _STEP // max(dim, 1))
    for a in range(0, len(x), step):
        yield a, x[a:a + step]


def _sums(centroids: np.ndarray):
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia = [0] * k, [0] * k
        sums = np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            for _, x in _blocks(batch, dim):
                cluster, distance = nearest(x, centroids)
                for c in range(k):
                    mine = cluster == c
                    count[c] += int(mine.sum())
                    inertia[c] += int(distance[mine].sum())
                    sums[c] += x[mine].sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {"c": range(k), "n": count, "inertia": inertia, "s": sums.tolist()},
            pa.schema([("c", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("s", pa.list_(pa.int64()))]))

    return run


def _assign(centroids: np.ndarray):
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(x, centroids) for _, x in _blocks(batch, dim)]
            if found:
                cluster, distance = (np.concatenate(f) for f in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                    names=["id", "cluster", "distance"])

    return run


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int = DIM, scale: float = SCALE) -> DataFrame:
    """(id, v): rows with exactly ``dim`` components, none null or non-finite; v holds floor(scale * x) of each."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    too_large = F.exists("v", lambda x: F.abs(x) >= limit(dim))
    kept = (df.select(F.col(id_col).alias("id"), v.alias("v")).where((F.size("v") == dim) & finite)
            .withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x))))
    return kept.select("id", F.when(too_large, F.raise_error(F.lit(f"a component reaches {limit(dim)}")))
                       .otherwise(F.col("v").cast("array<int>")).alias("v"))


def _first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def cluster_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int = DIM, k: int = K, rounds: int = ROUNDS,
                    seed: int = 3, scale: float = SCALE) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): a row for each vector that is kept.

    The vectors with the smallest SHA-256 of ``seed:id`` are the first
    centroids; every round assigns all vectors (squared Euclidean distance,
    ties to the smaller number) and moves each non-empty centroid to the
    component-wise floor of its mean; a last pass assigns once more.
    cluster_inertia and inertia sum the distances over the cluster and over
    all; centroid is the final one.

    Vectors of another length, null ones and those with a null or non-finite
    component are left out; one with a component of ``limit(dim)`` or more
    after scaling raises, as its distances need not fit a long.  Rows equal in id are
    vectors of their own; a null id hashes as ``null``; of equal ids the smaller
    vector is the earlier centroid; fewer than ``k`` vectors make as many
    centroids, and an empty table an empty result.  Other columns are not read.
    """
    if dim < 1 or k < 1:
        raise ValueError("at least one dimension and one centroid")
    vectors = materialize(integer_vectors(df, id_col, vector_col, dim, scale))
    kind = vectors.schema["id"].dataType.simpleString()
    centroids = _first_centroids(vectors, k, seed)
    if not len(centroids):
        return (vectors.selectExpr("id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia",
                                   "cast(v AS array<long>) AS centroid"))

    def totals() -> list:
        wide = "decimal(38,0)"
        sums = F.array(*[F.sum(F.col("s")[d].cast(wide)) for d in range(dim)])
        return (vectors.select("v").mapInArrow(_sums(centroids), "c int, n long, inertia long, s array<long>")
                .groupBy("c").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), sums.alias("s")).collect())

    for _ in range(rounds):
        before = centroids.copy()
        for row in totals():
            if row.n:
                centroids[row.c] = [int(s) // row.n for s in row.s]
        if (before == centroids).all():
            break  # every further round would give these again
    last = {row.c: row.inertia for row in totals()}
    about = vectors.sparkSession.createDataFrame(
        [(c, last[c], sum(last.values()), centroids[c].tolist()) for c in range(len(centroids))],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    rows = vectors.mapInArrow(_assign(centroids), f"id {kind}, cluster int, distance long")
    return (rows.join(F.broadcast(about), "cluster")  # k rows
            .select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"))
