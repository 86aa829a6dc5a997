"""SimHash near-dedup with BK-trees.

Fingerprints are made per document in Arrow batches.  Two fingerprints at most
``radius`` bits apart agree on at least one of ``radius + 1`` bit blocks, so
each block value is a shard; a shard's fingerprints form a BK-tree (children
keyed by the integer Hamming distance to the parent) and every member searches
the tree, following only edges within the radius.  One tree of all
fingerprints grows with the corpus and is therefore not broadcast: queries
travel to the shard trees instead.  A shard above ``shard_rows`` is split
again by blocks of its remaining bits, which loses no pair by the same
argument.  A shard gives one link per fingerprint to its tree's smallest
connected member, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankscope.llm.common import connected_components, materialize, numbered, text_key
from rankscope.session import num_partitions

SHINGLE = 3
RADIUS = 3
SEED = 42
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text (null: no words)."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, n = [b" ".join(words)], 1
        width = 1
    else:
        n, width = len(words) - shingle + 1, shingle
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _STEP):
        part = words[at:min(at + _STEP, n) + width - 1]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(s), seed)
                      for s in zip(*(part[k:] for k in range(width)))], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp",
                     shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` plus ``out``, the last column: the signed long holding the 64 fingerprint bits."""
    names = docs.columns
    docs, (text_col,) = numbered(docs, text_col)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64)
                         .view(np.int64))

    return docs.select("*", fp(F.col(text_col).cast("string"))).toDF(*names, out)


class Forest:
    """BK-trees of several shards in arrays: one root per shard, edges sorted by (parent, distance)."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        """``shard`` is sorted; ``fp`` (uint64) holds no value twice within a shard."""
        n = len(fp)
        self.fp = fp
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, int)
        self.root = np.repeat(starts, np.diff(np.r_[starts, n]))
        wait = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        at, keys, kids = self.root[wait], [], []
        while len(wait):
            edge = at * 65 + np.bitwise_count(fp[wait] ^ fp[at])
            key, first, inverse = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(key)
            kids.append(wait[first])
            at = wait[first][inverse]
            left = np.ones(len(wait), dtype=bool)
            left[first] = False
            wait, at = wait[left], at[left]
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.kid = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        order = np.argsort(self.key, kind="stable")
        self.key, self.kid = self.key[order], self.kid[order]

    def near(self, radius: int, chunk: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, other member) within ``radius``, in bounded portions."""
        n = len(self.fp)
        work = [(np.arange(a, min(a + chunk, n)), self.root[a:a + chunk]) for a in range(0, n, chunk)]
        while work:
            q, node = work.pop()
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            many = hi - lo
            q, lo, many = q[many > 0], lo[many > 0], many[many > 0]
            cuts = np.searchsorted(np.cumsum(many), np.arange(chunk, many.sum() + chunk, chunk), "left") + 1
            for a, b in zip(np.r_[0, cuts[:-1]], cuts):
                c = many[a:b]
                if len(c):
                    edge = np.repeat(lo[a:b] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
                    work.append((np.repeat(q[a:b], c), self.kid[edge]))

    def labels(self, radius: int) -> np.ndarray:
        """For each member the smallest index connected to it within its shard."""
        lab = np.arange(len(self.fp))
        for q, node in self.near(radius):
            while True:
                a, b = lab[q], lab[node]
                apart = a != b
                if not apart.any():
                    break
                q, node, a, b = q[apart], node[apart], a[apart], b[apart]
                np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
                while True:
                    up = lab[lab]
                    if (up == lab).all():
                        break
                    lab = up
        return lab


def _shard_links(radius: int, rows: int):
    """mapInPandas body over partitions sorted by shard: links to the smallest connected member."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64)
        lab = Forest(pdf["shard"].to_numpy(np.int64), fp.view(np.uint64)).labels(radius)
        far = lab != np.arange(len(lab))
        return pd.DataFrame({"u": fp[far], "v": fp[lab[far]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= rows:
                whole = pd.concat(held, ignore_index=True)
                tail = whole["shard"] == whole["shard"].iloc[-1]  # its shard may go on
                if not tail.all():
                    yield links(whole[~tail])
                held, n = [whole[tail].reset_index(drop=True)], int(tail.sum())
        if n:
            yield links(pd.concat(held, ignore_index=True))

    return run


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    size, more = divmod(len(bits), parts)
    ends = [k * size + min(k, more) for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(ends, ends[1:])]


def _pieces(path: str, parts: int) -> list[list[int]]:
    """Bit blocks of the level below ``path``; "03" is block 0, then block 3 of the other bits."""
    bits = list(range(64))
    for step in path:
        bits = [b for k, piece in enumerate(_cut(bits, parts)) if k != int(step) for b in piece]
    return _cut(bits, parts)


def _block_value(paths: list[str], parts: int) -> Column:
    """The fingerprint's bits in block ``cut`` of the row's ``path``."""
    cases = []
    for path in paths:
        for k, piece in enumerate(_pieces(path, parts)):
            mask = sum(1 << b for b in piece)
            value = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
            cases.append(F.when((F.col("path") == path) & (F.col("cut") == k), value))
    return F.coalesce(*cases)


def near_links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = 4096, levels: int = 3) -> DataFrame:
    """(u, v): links that connect all pairs of distinct ``fp`` values within ``radius`` bits.

    Nulls and repeated values in ``fps`` are left out; no rows give no links.
    """
    parts, n = radius + 1, num_partitions(fps.sparkSession)
    if not 0 <= radius <= 8:
        raise ValueError("radius must be 0 to 8")
    level = (fps.select(F.col("fp").cast("long").alias("fp")).where("fp is not null").distinct()
             .select("fp", F.lit(0).cast("long").alias("shard"), F.lit("").alias("path")))
    paths, out = [""], None
    for depth in range(levels):
        split = materialize(
            level.withColumn("cut", F.explode(F.array(*[F.lit(k) for k in range(parts)])))
            .select("fp", F.xxhash64("shard", "path", "cut", _block_value(paths, parts)).alias("shard"),
                    F.concat("path", F.col("cut").cast("string")).alias("path")))
        paths = [p + str(k) for p in paths for k in range(parts)]
        here, large = split, None
        if depth < levels - 1:
            large = materialize(split.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard"))
            if not large.isEmpty():
                here = split.join(large, "shard", "left_anti")
        found = (here.select("shard", "fp").repartition(n, "shard").sortWithinPartitions("shard", "fp")
                 .mapInPandas(_shard_links(radius, 200_000), "u long, v long"))
        out = found if out is None else out.union(found)
        if here is split:
            break
        level = split.join(large, "shard", "left_semi")
    return out


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int,
                seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, fp) of every row, and (fp, root) of every fingerprint."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fps = materialize(with_fingerprint(ids, "text", "fp", shingle, seed)
                      .select("id", text_key("text").alias("key"), "fp"))
    comp = materialize(connected_components(near_links(fps, radius)))
    roots = (fps.select("fp").distinct().join(comp, F.col("fp") == F.col("node"), "left")
             .select("fp", F.coalesce("component", "fp").alias("root")))
    return fps, materialize(roots)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` as (id, fp, component_id).

    component_id is the smallest id whose fingerprint can be reached by links
    of at most ``radius`` bits.  Null and empty texts have fingerprint zero
    and link like any other; a row without an id never names a component
    (null only if no row of the component has an id); repeated rows stay
    repeated; an empty table gives an empty one.  Other columns of ``docs``
    are not read.
    """
    fps, roots = _components(docs, id_col, text_col, shingle, radius, seed)
    ids = fps.groupBy("fp").agg(F.min("id").alias("id"))
    low = materialize(ids.join(roots, "fp").groupBy("root").agg(F.min("id").alias("component_id")))
    named = materialize(roots.join(low, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("id", "fp", "component_id")


def text_clusters(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                  seed: int = SEED) -> DataFrame:
    """(key, cluster): the component of each distinct text, by the digest of the text (``common.text_key``)."""
    fps, roots = _components(docs, text_col, text_col, shingle, radius, seed)
    return fps.select("key", "fp").distinct().join(roots, "fp").select("key", F.col("root").cast("string").alias("cluster"))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one document of each component.

    The smallest id stays, rows without an id only where no other row is left;
    among texts of one id the one with the smallest digest.  Of rows equal in
    id and text one stays.  An empty table gives an empty one.
    """
    names = docs.columns
    docs, (id_col, text_col) = numbered(docs, id_col, text_col)
    fps, roots = _components(docs, id_col, text_col, shingle, radius, seed)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    ids = fps.groupBy("fp").agg(first.alias("best"))
    best = (ids.join(roots, "fp").groupBy("root").agg(F.min("best").alias("best"))
            .select(F.col("best.id").alias("_id"), F.col("best.key").alias("_key")))
    best = materialize(best)
    rows = docs.withColumn("_text_key", text_key(text_col))
    kept = rows.join(best, rows[id_col].eqNullSafe(best["_id"]) & (rows["_text_key"] == best["_key"]), "left_semi")
    if not fps.groupBy("id", "key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "_text_key"])
    return kept.drop("_text_key").toDF(*names)
