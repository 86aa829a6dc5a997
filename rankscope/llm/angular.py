"""Hard-negative mining by angular triangle filtering.

An anchor's positives are its best rows of the same label by integer inner
product; for each positive, the negatives are the best rows of other labels
whose score lies in a window below the positive's.

Rows are dealt into blocks of bounded size.  A block picks reference directions
among its own rows, each the farthest from those before, and stores every row's
norm and angles to them.  Anchors stream past the block.  With the anchor's
angles to the same references, the triangle inequality of angles gives for each
row an interval of the angle between both, so of its cosine; norms turn it into
a score interval, widened by more than rounding can have moved it.  Only rows
whose interval overlaps a window are scored, in exact integers: for positives
the window from the best scores known so far, for negatives the windows below
the positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankscope.llm.common import materialize
from rankscope.session import num_partitions

#: Positives of an anchor, and negatives of each positive.
TOP = 5
#: A negative's score in per cent of its positive's at least.
LOW = 80
SCALE = 256.0
REFERENCES = 16
#: Components of a block at least and at most, and blocks wanted between these.
LEAST, MOST, BLOCKS = 1 << 17, 1 << 24, 256
#: The length times the square of any component stays below this, so that scores fit a long.
LIMIT = float(1 << 62)


class Block:
    """Rows of one length, sorted by label, with stored norms and angles to reference directions."""

    def __init__(self, number: np.ndarray, vec_id: list, label: np.ndarray, x: np.ndarray):
        by_id = sorted(range(len(vec_id)), key=lambda k: (vec_id[k] is None, vec_id[k] or 0, number[k]))
        place = np.empty(len(by_id), dtype=np.int64)
        place[by_id] = np.arange(len(by_id))
        order = np.lexsort((place, label))
        self.number, self.place, self.x = number[order], place[order], x[order]
        self.vec_id = [vec_id[k] for k in order.tolist()]
        labels, first, count = np.unique(label[order], return_index=True, return_counts=True)
        self.labels = {k: slice(a, a + n) for k, a, n in zip(labels.tolist(), first.tolist(), count.tolist())}
        self.real = self.x.astype(np.float64)
        self.norm = np.sqrt((self.real ** 2).sum(axis=1))
        unit = self._unit(self.real, self.norm)
        self.largest = np.abs(self.real).max(initial=0)
        # More than the sum of two angles' errors: near 0 and pi an angle is off by the root of its cosine's error.
        self.slack = 4 * np.sqrt(2 * (x.shape[1] + 8) * np.finfo(np.float64).eps)
        picked, near = [], np.where(self.norm > 0, -2.0, 1.0)
        while len(picked) < REFERENCES and near.min(initial=1) < 1 - 1e-9:
            picked.append(int(near.argmin()))
            near = np.maximum(near, unit @ unit[picked[-1]])
        self.references = unit[picked]
        self.angles = np.arccos(np.clip(unit @ self.references.T, -1, 1))

    @staticmethod
    def _unit(real: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return real / np.where(norm > 0, norm, 1)[:, None]

    def bounds(self, anchor: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score of the rows with one anchor."""
        real = anchor.astype(np.float64)
        norm = np.sqrt((real ** 2).sum())
        mine = np.arccos(np.clip(self.references @ (real / (norm or 1)), -1, 1))
        theirs = self.angles[rows]
        least = np.abs(theirs - mine).max(axis=1, initial=0) - self.slack
        total = theirs + mine
        most = np.minimum(total, 2 * np.pi - total).min(axis=1, initial=np.pi) + self.slack
        size = norm * self.norm[rows] * (1 + 1e-9)
        high, low = np.cos(np.clip(least, 0, np.pi)), np.cos(np.clip(most, 0, np.pi))
        # A zero vector has no angle, but a size of zero.
        return np.floor(size * low - 1e-9 * size) - 1, np.ceil(size * high + 1e-9 * size) + 1

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if len(anchor) * np.abs(anchor).max(initial=0) * self.largest < 2 ** 53:
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)  # every partial sum is exact
        return self.x[rows] @ anchor

    def of_label(self, label: int) -> slice:
        return self.labels.get(label, slice(0, 0))

    def best(self, scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places in ``rows`` of the TOP first by score, id and row number; a null id is the last."""
        if len(rows) > TOP:
            least = np.partition(scores, len(scores) - TOP)[len(scores) - TOP]
            above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
            left = TOP - len(above)
            if len(ties) > left:
                ties = ties[np.argpartition(self.place[rows[ties]], left - 1)[:left]]
            some = np.r_[above, ties]
        else:
            some = np.arange(len(rows))
        return some[np.lexsort((self.place[rows[some]], -scores[some]))]

    def positives(self, number: int, label: int, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores) of the anchor's best rows of its label here, and how many rows were scored."""
        there = self.of_label(label)
        rows = np.arange(there.start, there.stop)
        rows = rows[self.number[rows] != number]
        if len(rows) > TOP:
            _, most = self.bounds(anchor, there)
            most = most[rows - there.start]
            start = rows[np.argpartition(-most, TOP - 1)[:TOP]]
            rows = rows[most >= self.scores(anchor, start).min()]
        scores = self.scores(anchor, rows)
        first = self.best(scores, rows)
        return rows[first], scores[first], len(rows)

    def negatives(self, label: int, anchor: np.ndarray, windows: list[int]) -> tuple[list[tuple], int]:
        """For each positive score of ``windows`` (rows, scores) of its negatives here; how many rows were scored."""
        least, most = self.bounds(anchor, slice(None))
        there = self.of_label(label)
        overlaps = np.zeros(len(least), dtype=bool)
        for p in set(windows):
            overlaps |= (most >= -(-LOW * p // 100)) & (least <= p)
        overlaps[there] = False
        rows = np.flatnonzero(overlaps)
        scores = self.scores(anchor, rows)
        found = {}
        for p in set(windows):
            fits = np.flatnonzero((scores >= -(-LOW * p // 100)) & (scores <= p))
            first = fits[self.best(scores[fits], rows[fits])]
            found[p] = rows[first], scores[first]
        return [found[p] for p in windows], len(rows)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.RecordBatch, np.ndarray]]:
    """(block, anchors, their vectors) of batches sorted by length and block, a block's rows before its anchors."""
    held: list[pa.RecordBatch] = []
    block, key = None, None
    for batch in batches:
        dims, blocks, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "block", "kind"))
        new = (np.diff(dims) != 0) | (np.diff(blocks) != 0) | (np.diff(kinds) != 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(dims)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part, dim = batch.slice(a, b - a), int(dims[a])
            if key != (dim, blocks[a]):
                held, block, key = [], None, (dim, blocks[a])
            if kinds[a] == 0:
                held.append(part)
                continue
            if held:
                number, label = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in held])
                                 for c in ("number", "label"))
                block = Block(number, [i for p in held for i in p.column("id").to_pylist()], label,
                              np.concatenate([_vectors(p, dim) for p in held]))
                held = []
            if block:
                yield block, part, _vectors(part, dim)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(batch.num_rows, dim)


def _positives(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, x in _streams(batches):
            out: dict[str, list] = {c: [] for c in ("anchor", "row", "id", "score")}
            for number, label, v in zip(part.column("number").to_pylist(), part.column("label").to_pylist(), x):
                rows, scores, _ = block.positives(number, label, v)
                out["anchor"] += [number] * len(rows)
                out["row"] += block.number[rows].tolist()
                out["id"] += [block.vec_id[k] for k in rows.tolist()]
                out["score"] += scores.tolist()
            yield pa.RecordBatch.from_pydict(out, pa.schema(
                [("anchor", pa.int64()), ("row", pa.int64()), ("id", kind), ("score", pa.int64())]))

    return run


def _negatives(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, x in _streams(batches):
            out: dict[str, list] = {c: [] for c in ("anchor", "place", "row", "id", "score")}
            for number, label, windows, v in zip(part.column("number").to_pylist(), part.column("label").to_pylist(),
                                                 part.column("windows").to_pylist(), x):
                for place, (rows, scores) in enumerate(block.negatives(label, v, windows)[0]):
                    out["anchor"] += [number] * len(rows)
                    out["place"] += [place] * len(rows)
                    out["row"] += block.number[rows].tolist()
                    out["id"] += [block.vec_id[k] for k in rows.tolist()]
                    out["score"] += scores.tolist()
            yield pa.RecordBatch.from_pydict(out, pa.schema(
                [("anchor", pa.int64()), ("place", pa.int32()), ("row", pa.int64()), ("id", kind),
                 ("score", pa.int64())]))

    return run


def integer_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str, is_anchor: Column,
                 scale: float = SCALE) -> DataFrame:
    """(number, id, label, anchor, dim, v) of the rows that take part; v holds floor(scale * x) of each component."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    large = F.exists("x", lambda c: F.pow(F.lit(scale) * c, F.lit(2.0)) * F.size("x") >= LIMIT)
    rows = (df.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"),
                      F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
            .where(F.col("x").isNotNull() & F.col("label").isNotNull()).where(finite))
    v = F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("number"), "id", "label", "anchor",
                       F.size("x").alias("dim"),
                       F.when(large, F.raise_error(F.lit("components too large for scores of 64 bits")))
                       .otherwise(v).alias("v"))


def hard_negatives(df: DataFrame, id_col: str, vector_col: str, label_col: str, is_anchor: Column,
                   scale: float = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row with ``is_anchor`` and each of its positives, the first TOP
    other rows of its label, the first TOP rows of other labels whose score is
    from LOW per cent of the positive's up to the positive's; score: integer
    inner product with the anchor; higher ones come first, then smaller ids.

    Rows with a null label, a null vector or a null or non-finite component
    take no part; vectors of different lengths have no product and are no
    candidates for each other; a zero vector has the score 0; one with too
    large components raises, as its scores need not fit a long.  Rows equal in id
    are rows of their own, as anchors too (their results repeat); a null id is
    the last among equal scores.  No anchors or an empty table give an empty
    result.  Labels are integral; other columns are not read.
    """
    spark = df.sparkSession
    rows = materialize(integer_rows(df, id_col, vector_col, label_col, is_anchor, scale))
    parts = num_partitions(spark)
    total = rows.agg(F.coalesce(F.sum(F.greatest("dim", F.lit(1))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // MOST), min(max(BLOCKS, parts), -(-total // LEAST)))
    kind, arrow = rows.schema["id"].dataType.simpleString(), _arrow_type(rows)
    none = F.lit(None).cast("array<long>")
    there = rows.select("dim", F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"),
                        "number", "id", "label", "v", none.alias("windows"))

    def visits(anchors: DataFrame) -> DataFrame:
        """Every block's rows, then all anchors of its length."""
        copies = anchors.select("dim", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"),
                                F.lit(1).alias("kind"), "number", "id", "label", "v", "windows")
        return (there.union(copies).repartition(parts, "dim", "block").sortWithinPartitions("dim", "block", "kind"))

    def first(found: DataFrame, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)

    anchors = rows.where("anchor").drop("anchor")
    found = visits(anchors.withColumn("windows", none)).mapInArrow(
        _positives(arrow), f"anchor long, row long, id {kind}, score long")
    positives = materialize(first(found, "anchor").groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p")))
    asked = anchors.join(positives, F.col("number") == F.col("anchor")).drop("anchor")
    found = visits(asked.withColumn("windows", F.col("p.score"))).mapInArrow(
        _negatives(arrow), f"anchor long, place int, row long, id {kind}, score long")
    best = first(found, "anchor", "place").withColumnRenamed("id", "negative_id")
    about = asked.select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id"), "p")
    positive = F.element_at("p", F.col("place") + 1)
    return best.join(about, "anchor").select("anchor_id", positive["id"].alias("positive_id"), "rank", "negative_id",
                                             positive["score"].alias("positive_score"),
                                             F.col("score").alias("negative_score"))


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["id"].dataType)
