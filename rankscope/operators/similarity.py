"""Similarity: character n-gram TF-IDF (T4), row-wise dot (T5), exact top-k
over all question x context pairs (T6, T8, K1), row cosine (T7), distinct-text
reuse (J12).

All-pairs top-k never materialises the pair set as Spark rows.  Contexts are
dealt into blocks, each shuffled once; questions stream past the blocks that
can hold one of their k best and leave k rows there, and Spark merges these
with a top-k window (WindowGroupLimit).  Memory per task is bounded by the
block size.  Texts, not their vectors, are shuffled and written; vectors are
made where they are multiplied.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cached_property, partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankscope.functions.text import WHITESPACE_CLASS
from rankscope.operators.blocks import cross_blocks, lists_to_numpy, visit_blocks
from rankscope.operators.ranking import range_number, top_k
from rankscope.session import DEFAULT_BROADCAST_ROWS, conf_int, materialize

_log = logging.getLogger(__name__)

# Similarities are compared after rounding to this many places so engines that
# add in a different order break ties the same way.
SCORE_PLACES = 10


def tfidf_text(x: Column | str) -> Column:
    """Vectoriser preprocessing: lower-case, runs of 2+ whitespace -> one space."""
    c = F.col(x) if isinstance(x, str) else x
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), WHITESPACE_CLASS + "{2,}", " ")


def gram_ids(text: str, n_min: int = 2, n_max: int = 4) -> np.ndarray:
    """64-bit ids of all character n-grams of ``text``, n_min..n_max, every start position (code points)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out, h = [], None
    for n in range(1, n_max + 1):
        if len(c) < n:
            break
        h = c + np.uint64(1) if h is None else h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:] + np.uint64(1)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        if n >= n_min:
            out.append(h + np.uint64(n))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


#: Code points at most, but for one text, whose grams are made at once.
TEXTS_CHARS = 1 << 15


def gram_ids_of(texts: Sequence[str], n_min: int = 2, n_max: int = 4) -> Iterator[np.ndarray]:
    """``gram_ids`` of each of ``texts``, made for several short texts at once: most of the time of one is calls."""

    def made(some: list[str]) -> Iterator[np.ndarray]:
        whole = gram_ids("".join(some), n_min, n_max)
        total, start = sum(map(len, some)), 0
        for text in some:
            out, base = [], 0
            for n in range(n_min, n_max + 1):  # the grams of a size lie together, one for each start
                out.append(whole[base + start:base + max(start, start + len(text) - n + 1)])
                base += max(total - n + 1, 0)
            yield np.concatenate(out)
            start += len(text)

    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > TEXTS_CHARS:
            yield from made(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield from made(held)


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct grams and how often each comes."""
    grams = np.sort(grams)
    new = np.ones(len(grams), dtype=bool)
    np.not_equal(grams[1:], grams[:-1], out=new[1:])
    first = np.flatnonzero(new)
    n = np.full(len(first), len(grams), dtype=np.int64)
    n[:-1] = first[1:]
    return grams[first], n - first


#: Grams at most of one batch that a Python worker gives out, and of the counts that it holds.
BATCH_GRAMS, HELD_GRAMS = 1 << 18, 1 << 20


def _bounded(rows: Iterator[tuple], columns: Callable[[list], pa.RecordBatch], most: int = BATCH_GRAMS) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose first field, an array, has about ``most`` values together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0]) + 1
        if size >= most:
            yield columns(held)
            held, size = [], 0
    if held:
        yield columns(held)


def gram_counts(docs: DataFrame, key: str, text: str, mult: str | None = None, n_min: int = 2,
                n_max: int = 4) -> DataFrame:
    """(k, m, grams, tf): ascending gram ids of each prepared text and how often it holds them.

    A collision of ids (about n^2 / 2^65) would merge two grams.  A worker
    gives its rows out in batches of bounded size, as a text has thousands of grams.
    """
    m = F.col(mult).cast("long") if mult else F.lit(1).cast("long")
    rows = docs.select(F.col(key).alias("k"), m.alias("m"), tfidf_text(text).alias("_t"))
    schema = T.StructType([rows.schema["k"], T.StructField("m", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType())),
                           T.StructField("tf", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def columns(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([k for *_, k, _ in held]), pa.concat_arrays([m for *_, m in held]),
            pa.array([g for g, *_ in held], arrow.field("grams").type),
            pa.array([n for _, n, *_ in held], arrow.field("tf").type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                k, m, t = (batch.column(i) for i in range(3))
                for i, text in enumerate(t.to_pylist()):
                    grams, n = np.unique(gram_ids(text, n_min, n_max), return_counts=True)
                    yield grams, n.astype(np.int32), k.slice(i, 1), m.slice(i, 1)
        return _bounded(each(), columns)

    return rows.mapInArrow(run, schema)


def document_frequencies(docs: DataFrame, text: str, mult: str, n_min: int = 2, n_max: int = 4) -> DataFrame:
    """(gram, df): for every gram of the texts the sum of ``mult`` over the rows that hold it.

    Tasks add up their own rows first and give the sums out where they get many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            grams, n = np.concatenate(keys), np.concatenate(sums)
            order = np.argsort(grams, kind="stable")
            grams, n = grams[order], n[order]
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
            return grams[first], np.add.reduceat(n, first) if len(first) else n

        def out() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys[0]), BATCH_GRAMS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][a:a + BATCH_GRAMS]), pa.array(sums[0][a:a + BATCH_GRAMS])],
                                                 names=["gram", "df"])

        for batch in batches:
            for ids, m in zip(gram_ids_of(batch.column(0).to_pylist(), n_min, n_max), batch.column(1).to_pylist()):
                grams, _ = distinct(ids)
                keys.append(grams)
                sums.append(np.full(len(grams), m, np.int64))
                held += len(grams)
                if held >= HELD_GRAMS:
                    (grams, n), held = merged(), 0
                    keys, sums = [grams], [n]
                    if len(grams) >= HELD_GRAMS:
                        yield from out()
                        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        grams, n = merged()
        keys, sums = [grams], [n]
        yield from out()

    rows = docs.select(tfidf_text(text).alias("t"), F.col(mult).cast("long").alias("m")).where("m is not null")
    return rows.mapInArrow(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


class Weights(NamedTuple):
    """A fitted weighting: ``table`` is a broadcast of ascending grams and their idf, or None where they are too many;
    ``df`` has (gram, idf)."""

    df: DataFrame
    table: object | None
    n_min: int = 2
    n_max: int = 4


def fit_weights(docs: DataFrame, text: str, mult: str, n_min: int = 2, n_max: int = 4) -> Weights:
    """T4: smooth idf  ln((1+N)/(1+df)) + 1 of all grams; a row counts ``mult`` times."""
    spark = docs.sparkSession
    n_docs = docs.agg(F.sum(F.col(mult).cast("long"))).first()[0] or 0
    df = materialize(document_frequencies(docs, text, mult, n_min, n_max))
    idf = df.select("gram", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    if df.count() > conf_int(spark, "rankscope.broadcastRows", DEFAULT_BROADCAST_ROWS):
        return Weights(idf, None, n_min, n_max)
    table = idf.orderBy("gram").toArrow()
    return Weights(idf, spark.sparkContext.broadcast((table.column("gram").to_numpy(), table.column("idf").to_numpy())),
                   n_min, n_max)


def _weigh(grams: np.ndarray, n: np.ndarray, table: tuple[np.ndarray, np.ndarray] | Lookup) -> np.ndarray:
    if not len(grams):
        return np.zeros(0, dtype=np.float64)
    idf = table[grams] if isinstance(table, Lookup) else table[1][np.searchsorted(table[0], grams)]
    w = np.asarray(n, dtype=np.float64) * idf
    return w / np.sqrt((w * w).sum()) if len(w) else w


class Lookup:
    """A task's own index of a table of ascending grams and their idf: most grams are found by one look at a slot."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        self.grams, self.idf = table
        self.mask = (4 << max(len(self.grams), 1).bit_length()) // 2 - 1
        self.slots = np.zeros(self.mask + 1, dtype=np.int32)
        self.slots[self.grams & self.mask] = np.arange(len(self.grams), dtype=np.int32)

    def __getitem__(self, grams: np.ndarray) -> np.ndarray:
        at = self.slots[grams & self.mask]
        others = np.flatnonzero(self.grams[at] != grams)  # those whose slot another gram has
        at[others] = np.searchsorted(self.grams, grams[others])
        return self.idf[at]


def text_vector(text: str, weights: tuple, n_min: int, n_max: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending grams of a prepared text and their normalised weights."""
    return next(text_vectors([text], weights, n_min, n_max))


def text_vectors(texts: Sequence[str], weights: tuple | Lookup, n_min: int, n_max: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``text_vector`` of each of ``texts``."""
    for ids in gram_ids_of(texts, n_min, n_max):
        grams, n = distinct(ids)
        yield grams, _weigh(grams, n, weights)


def sparse_dot(g: np.ndarray, w: np.ndarray, h: np.ndarray, v: np.ndarray) -> float:
    """Dot product of two vectors of ascending grams, added up in the order of the grams."""
    if len(g) > len(h):
        g, w, h, v = h, v, g, w
    if not len(g):
        return 0.0
    at = np.searchsorted(h, g)
    at[at == len(h)] = 0
    both = h[at] == g
    return float(np.dot(w[both], v[at[both]]))


def _vectors(docs: DataFrame, weights: Weights) -> DataFrame:
    """(k, grams, weights) of documents (k, t, m)."""
    if weights.table is not None:
        rows, shared, n_min, n_max = docs.select("k", tfidf_text("t").alias("_t")), weights.table, weights.n_min, weights.n_max
        schema = T.StructType([rows.schema["k"], T.StructField("grams", T.ArrayType(T.LongType())),
                               T.StructField("weights", T.ArrayType(T.DoubleType()))])
        arrow = to_arrow_schema(schema)

        def columns(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays([k for *_, k in held]),
                                               pa.array([g for g, *_ in held], arrow.field("grams").type),
                                               pa.array([w for _, w, _ in held], arrow.field("weights").type)], schema=arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = ((*text_vector(t, shared.value, n_min, n_max), batch.column(0).slice(i, 1))
                    for batch in batches for i, t in enumerate(batch.column(1).to_pylist()))
            return _bounded(each, columns)

        return rows.mapInArrow(run, schema)
    tf = materialize(gram_counts(docs, "k", "t", "m", weights.n_min, weights.n_max))
    w = (tf.select("k", F.explode(F.arrays_zip("grams", "tf")).alias("x")).select("k", F.col("x.grams").alias("gram"), "x.tf")
         .join(weights.df, "gram").select("k", "gram", (F.col("tf") * F.col("idf")).alias("w")))
    vec = w.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("gram", "w"))).alias("v"),
                             F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vec = vec.select("k", F.col("v.gram").alias("grams"), F.transform("v.w", lambda x: x / F.col("norm")).alias("weights"))
    none = {"grams": F.coalesce("grams", F.array().cast("array<bigint>")),
            "weights": F.coalesce("weights", F.array().cast("array<double>"))}
    return tf.select("k").join(vec, "k", "left").withColumns(none)


def tfidf_packed(docs: DataFrame, key: str, text: str, mult: str | None = None, n_min: int = 2,
                 n_max: int = 4) -> DataFrame:
    """T4: (key, grams, weights): raw tf x smooth idf  ln((1+N)/(1+df)) + 1, L2-normalised, ascending by gram id.

    ``mult`` (optional) says how many documents a row stands for, so repeated
    texts are tokenised once but still counted in N and df (J12).  Document
    frequencies are looked up in a broadcast where they number at most
    ``rankscope.broadcastRows``, and joined by gram beyond it.  Vectors take
    about thirty times the space of their texts: operators over many rows move
    texts and make the vectors where they are used.
    """
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"),
                       (F.col(mult) if mult else F.lit(1)).cast("long").alias("m"))
    return _vectors(docs, fit_weights(docs, "t", "m", n_min, n_max)).withColumnRenamed("k", key)


def packed_dot(pairs: DataFrame, packed: DataFrame, key: str, pair_key: str, left_key: str, right_key: str,
               out: str = "similarity") -> DataFrame:
    """T5: ``pairs`` plus the dot product of its two sparse vectors; pairs sharing no gram get 0."""

    @F.pandas_udf("double")
    def dot(ga: pd.Series, wa: pd.Series, gb: pd.Series, wb: pd.Series) -> pd.Series:
        values = []
        for row in zip(ga, wa, gb, wb):
            values.append(sparse_dot(*row))
        return pd.Series(values, dtype="float64")

    left = packed.select(F.col(key).alias(left_key), F.col("grams").alias("_lg"), F.col("weights").alias("_lw"))
    right = packed.select(F.col(key).alias(right_key), F.col("grams").alias("_rg"), F.col("weights").alias("_rw"))
    return (pairs.join(left, left_key).join(right, right_key)
            .withColumn(out, dot("_lg", "_lw", "_rg", "_rw")).select(*pairs.columns, out))


def row_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two dense array columns; 0.0 when a norm is 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return F.when((na * nb) > 0, dot / (na * nb)).otherwise(F.lit(0.0))


#: Vectors of texts that a task keeps for its next pairs, and pairs whose vectors it makes at once.
KEPT_VECTORS, PAIRS_AT_ONCE = 256, 64


def text_similarity(pairs: DataFrame, pair_key: str, left: str, right: str, weights: Weights,
                    out: str = "similarity") -> DataFrame:
    """``pairs`` plus the dot product of the vectors of two text columns; texts sharing no gram get 0.

    The vectors are made where the pair lies and never leave the task.  Pairs
    that follow one another with an equal text share its vector.  Where the
    weighting is too large for one table the vectors are joined to the pairs.
    Pairs may bring the prepared right texts in a column ``_rt``, which is left
    out of the result.
    """
    ready = F.col("_rt") if "_rt" in pairs.columns else tfidf_text(right)
    if weights.table is None:
        pairs = materialize(pairs.drop("_rt"))
        texts = (pairs.select(F.col(left).alias("t")).unionByName(pairs.select(F.col(right).alias("t"))).distinct()
                 .select(F.md5("t").alias("k"), "t", F.lit(1).cast("long").alias("m")))
        keyed = pairs.select(pair_key, F.md5(left).alias("lk"), F.md5(right).alias("rk"))
        scored = packed_dot(keyed, materialize(_vectors(texts, weights)), "k", pair_key, "lk", "rk", out)
        return pairs.join(scored.select(pair_key, out), pair_key)
    shared, n_min, n_max = weights.table, weights.n_min, weights.n_max
    rows = pairs.select(*[x for x in pairs.columns if x != "_rt"], tfidf_text(left).alias("_lt"), ready.alias("_rt"))
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple] = {}
        idf = Lookup(shared.value)

        for batch in batches:
            values = []
            both = list(zip(batch.column("_lt").to_pylist(), batch.column("_rt").to_pylist()))
            for i in range(0, len(both), PAIRS_AT_ONCE):
                some = both[i:i + PAIRS_AT_ONCE]
                new = [t for t in dict.fromkeys(t for pair in some for t in pair) if t not in kept]
                kept.update(zip(new, text_vectors(new, idf, n_min, n_max)))
                values += [sparse_dot(*kept[a], *kept[b]) for a, b in some]
                for old in list(kept)[:max(len(kept) - KEPT_VECTORS, 0)]:
                    del kept[old]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(values, pa.float64())],
                                             names=[*batch.schema.names[:-2], out])

    return rows.mapInArrow(run, schema)


def similarity(pairs: DataFrame, pair_key: str, left: str, right: str, backend: str = "tfidf",
               out: str = "similarity") -> DataFrame:
    """(pair_key, out) for the columns ``left`` and ``right`` of each row of ``pairs``.

    ``backend`` "tfidf" takes texts and fits the weighting on both columns;
    "vectors" takes stored dense vectors and gives their cosine.
    """
    if backend == "vectors":
        return pairs.select(pair_key, row_cosine(left, right).alias(out))
    if backend != "tfidf":
        raise ValueError(f"unknown similarity backend {backend!r}; expected tfidf or vectors")
    pairs = pairs.select(pair_key, F.col(left).alias("_a"), F.col(right).alias("_b"))
    texts = (pairs.select(F.col("_a").alias("t")).unionByName(pairs.select(F.col("_b").alias("t")))
             .groupBy("t").agg(F.count(F.lit(1)).alias("m")))
    return text_similarity(pairs, pair_key, "_a", "_b", fit_weights(texts, "t", "m"), out).select(pair_key, out)


# --------------------------------------------------------------------------- top k

def _flat(grams: Sequence[np.ndarray], weights: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All grams, all weights and the rows' sizes of a list of sparse rows."""
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    return (np.concatenate([np.zeros(0, np.int64), *(np.asarray(g, dtype=np.int64) for g in grams)]),
            np.concatenate([np.zeros(0), *(np.asarray(w, dtype=np.float64) for w in weights)]), sizes)


class SparseBlock:
    """Inverted index over one block of sparse rows.

    Grams that many rows hold are multiplied as dense matrices, the rest is added up from short posting lists.
    ``near_packed`` does so in single precision, in half the time; the few pairs that matter are then added up exactly.
    """

    CELLS = 1 << 24
    #: Pairs of a row at most that ``exact`` adds up one by one.
    FEW = 128

    def __init__(self, grams: Sequence[np.ndarray], weights: Sequence[np.ndarray]):
        self._index(*_flat(grams, weights))

    @classmethod
    def packed(cls, grams: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> SparseBlock:
        """From all grams, all weights and the rows' sizes."""
        block = cls.__new__(cls)
        block._index(grams, weights, sizes)
        return block

    def _index(self, grams: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> None:
        self.n = len(sizes)
        self.rows = grams, weights, np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(grams, kind="stable")
        self.row, self.weight, ordered = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order], weights[order], grams[order]
        new = np.ones(len(grams), dtype=bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        self.starts = np.flatnonzero(new)
        self.grams, self.ends = ordered[self.starts], np.append(self.starts[1:], len(grams))
        held = self.ends - self.starts
        common = np.argsort(-held, kind="stable")[:self.CELLS // max(self.n, 1)]
        self.common = common[held[common] >= max(8, self.n // 50)]
        self.column = np.full(len(self.grams), -1)
        self.column[self.common] = np.arange(len(self.common))

    def _dense(self, kind: type) -> np.ndarray:
        out = np.zeros((self.n, len(self.common)), dtype=kind)
        of = np.repeat(self.column, self.ends - self.starts)
        out[self.row[of >= 0], of[of >= 0]] = self.weight[of >= 0]
        return out

    @cached_property
    def dense(self) -> np.ndarray:
        return self._dense(np.float64)

    @cached_property
    def dense_near(self) -> np.ndarray:
        return self._dense(np.float32)

    def scores(self, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Dot products of one sparse row with each row of the block."""
        return self.score_matrix([grams], [weights])[0]

    def score_matrix(self, grams: Sequence[np.ndarray], weights: Sequence[np.ndarray]) -> np.ndarray:
        """Dot products of each given sparse row with each row of the block."""
        return self.score_packed(*_flat(grams, weights))

    def score_packed(self, grams: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same, of rows given as all grams, all weights and their sizes."""
        out, cell, values = self._multiplied(grams, weights, sizes, self.dense)
        return out + np.bincount(cell, values, out.size).reshape(out.shape)

    def near_packed(self, grams: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``score_packed`` of rows of norm 1 and weights that are not negative in single precision, and for each row a
        bound of its errors.

        A product of rows is at most 1 and has at most as many terms as the given row, none of them negative, so that
        the rounding errors add up to less than 2^-24 for each term and a few for the conversions; twice that is told.
        """
        out, cell, values = self._multiplied(grams, weights, sizes, self.dense_near)
        np.add.at(out.reshape(-1), cell, values.astype(np.float32))
        return out, (sizes + 16) * 2.0 ** -23

    def _multiplied(self, grams: np.ndarray, weights: np.ndarray, sizes: np.ndarray,
                    dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products over the common grams, and cells and values that are to be added for the others."""
        m = len(sizes)
        who = np.repeat(np.arange(m), sizes)
        at = np.minimum(np.searchsorted(self.grams, grams), max(len(self.grams) - 1, 0))
        known = self.grams[at] == grams if len(self.grams) else np.zeros(len(grams), bool)
        who, at, weights = who[known], at[known], weights[known]
        column = self.column[at]
        left = np.zeros((m, dense.shape[1]), dtype=dense.dtype)
        left[who[column >= 0], column[column >= 0]] = weights[column >= 0]
        out = left @ dense.T
        who, at, weights = who[column < 0], at[column < 0], weights[column < 0]
        start, held = self.starts[at], self.ends[at] - self.starts[at]
        index = np.arange(held.sum()) + np.repeat(start - (np.cumsum(held) - held), held)
        cell = np.repeat(who * self.n, held) + self.row[index]
        return out, cell, self.weight[index] * np.repeat(weights, held)

    def exact(self, grams: np.ndarray, weights: np.ndarray, sizes: np.ndarray, wanted: Mapping[int, np.ndarray],
              step: int = 256) -> dict[int, np.ndarray]:
        """Rounded dot products of the given rows with those rows of the block that are ``wanted`` by number."""
        ends, (g, w, at), out = np.concatenate([[0], np.cumsum(sizes)]), self.rows, {}
        mine = lambda i: (grams[ends[i]:ends[i + 1]], weights[ends[i]:ends[i + 1]])
        many = [i for i, js in wanted.items() if len(js) > self.FEW]
        for a in range(0, len(many), step):
            some = many[a:a + step]
            for i, scores in zip(some, self.score_packed(*_flat(*zip(*map(mine, some))))):
                out[i] = np.round(scores[wanted[i]], SCORE_PLACES)
        for i, js in wanted.items():
            if i not in out:
                out[i] = np.round([sparse_dot(*mine(i), g[at[j]:at[j + 1]], w[at[j]:at[j + 1]]) for j in js.tolist()], SCORE_PLACES)
        return out


def top_indices(scores: np.ndarray, tie_rank: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best rows by (score desc, tie_rank asc) among mask."""
    cand = np.flatnonzero(mask)
    if k <= 0 or len(cand) == 0:
        return cand[:0]
    sc = scores[cand]
    if len(cand) > k:
        kth = np.partition(sc, len(sc) - k)[len(sc) - k]
        keep = sc >= kth
        cand, sc = cand[keep], sc[keep]
    order = np.lexsort((tie_rank[cand], -sc))
    return cand[order][:k]


def _top_rows(scores: np.ndarray, lid: list, rid: np.ndarray, tie: np.ndarray, k: int, exclude_same: bool) -> dict:
    """Columns lid, rid and similarity of the k best rows of a block for each visitor; similarities are rounded."""
    out: dict[str, list] = {"lid": [], "rid": [], "similarity": []}
    scores = np.round(scores, SCORE_PLACES)
    for i, own in enumerate(lid):
        best = top_indices(scores[i], tie, rid != own if exclude_same else np.ones(len(rid), dtype=bool), k)
        out["lid"] += [own] * len(best)
        out["rid"] += rid[best].tolist()
        out["similarity"] += scores[i][best].tolist()
    return out


def _result_schema(q: DataFrame, c: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("lid", q.schema["lid"].dataType), T.StructField("rid", c.schema["rid"].dataType),
                         T.StructField("similarity", T.DoubleType())])


def _merged(found: DataFrame, q_key: str, c_key: str, k: int) -> DataFrame:
    best = top_k(found, ["lid"], [F.col("similarity").desc(), F.col("rid").asc()], k)
    return best.select(F.col("lid").alias(q_key), F.col("rid").alias(c_key), "similarity", "pos")


class Best:
    """The k best rows of each visitor so far, by (score descending, id ascending), with a value kept beside each."""

    def __init__(self, visitors: int, k: int):
        self.k, self.rows = k, [[] for _ in range(visitors)]
        self.floor = np.full(visitors, -np.inf)

    def offer(self, first: int, scores: np.ndarray, rid: Sequence, tie: np.ndarray,
              beside: Callable[[dict], dict] | None = None) -> None:
        """Scores of the visitors from ``first`` on with each row of a block; -inf for a pair that is out.  ``beside``
        gives the values that are kept beside some rows of some visitors."""
        if self.k <= 0:
            return
        floor = self.floor[first:first + len(scores)]
        hits = (scores >= floor[:, None]) & (scores > -np.inf)
        chosen = {i: top_indices(scores[i], tie, hits[i], self.k) for i in np.flatnonzero(hits.any(axis=1)).tolist()}
        values = beside(chosen) if beside else {}
        for i, best in chosen.items():
            held = self.rows[first + i]
            held += [(-scores[i, j], rid[j] is not None, rid[j], values[i][n] if beside else None)
                     for n, j in enumerate(best.tolist())]
            held.sort(key=lambda x: x[:3] if x[1] else x[:2])
            del held[self.k:]
            if len(held) == self.k:
                floor[i] = -held[-1][0]

    def offer_near(self, first: int, near: np.ndarray, margin: np.ndarray, exact: Callable[[dict], dict], rid: Sequence,
                   tie: np.ndarray) -> None:
        """``offer`` of scores of which only ``near`` is known, from 0 on and not farther off than ``margin`` of each
        visitor; a pair that is out has -inf.  ``exact`` gives the scores of the pairs that may be among the best.
        """
        if self.k <= 0:
            return
        margin = margin + 1e-6  # for the rounding of scores and bounds
        bar = np.maximum(self.floor[first:first + len(near)] - margin, -1.0)
        hits, wanted = near >= bar.astype(np.float32)[:, None], {}
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            js = np.flatnonzero(hits[i])
            if len(js) > self.k:
                some = near[i, js]
                js = js[some >= np.partition(some, len(js) - self.k)[len(js) - self.k] - 2 * margin[i]]
            wanted[i] = js
        for i, scores in exact(wanted).items():
            js = wanted[i]
            self.offer(first + i, scores[None, :], [rid[j] for j in js.tolist()], tie[js])


def carried(docs: DataFrame, key: str, text: str, weights: Weights) -> DataFrame:
    """``docs`` with what their vectors are made of instead of the text: the prepared text ``_t``, or, where the
    weighting is too large for one table, the vectors themselves, ``grams`` and ``weights``."""
    if weights.table is not None:
        return docs.withColumn("_t", tfidf_text(text)).drop(text)
    vectors = _vectors(docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lit(1).cast("long").alias("m")), weights)
    return docs.drop(text).join(vectors.withColumnRenamed("k", key), key)


def sparse_rows(rows: pa.Table, weights: Lookup | tuple | None, n_min: int, n_max: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All grams, all weights and the rows' sizes of ``carried`` rows; ``weights`` are the table's arrays."""
    if weights is None:
        grams, sizes = lists_to_numpy(rows.column("grams"), "int64")
        return grams, lists_to_numpy(rows.column("weights"), "float64")[0], sizes
    made = list(text_vectors(rows.column("_t").to_pylist(), weights, n_min, n_max))
    return _flat([g for g, _ in made], [w for _, w in made])


def table_of(weights: Weights) -> Callable[[], Lookup | None]:
    """A function that gives a task its index of the table of a weighting, made once, or None without a table."""
    shared, made = weights.table, []

    def table() -> Lookup | None:
        if shared is not None and not made:
            made.append(Lookup(shared.value))
        return made[0] if made else None

    return table


def slices(grams: np.ndarray, weights: np.ndarray, sizes: np.ndarray, step: int) -> Iterator[tuple]:
    """(first row, grams, weights, sizes) of ``step`` packed rows after another."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(sizes), step):
        b = min(a + step, len(sizes))
        yield a, grams[ends[a]:ends[b]], weights[ends[a]:ends[b]], sizes[a:b]


def topk_texts(questions: DataFrame, contexts: DataFrame, q_key: str, c_key: str, text: str, weights: Weights, k: int,
               exclude_same: bool = False, block_rows: int = 4096, visitors: int = 1024) -> DataFrame:
    """T6 + K1: for every question the k contexts with the highest dot product of their TF-IDF vectors, order
    (similarity desc, context key asc).  Inputs are (key, text).  Output (q_key, c_key, similarity, pos).

    Every question meets every block of contexts, ``visitors`` at a time.  Both are written once, as texts; a block is
    indexed again for every part of the questions.  All pairs are scored in single precision, and those that this leaves
    among a question's k best exactly.
    """
    q = carried(questions.select(F.col(q_key).alias("lid"), text), "lid", text, weights)
    c = carried(contexts.select(F.col(c_key).alias("rid"), text), "rid", text, weights)
    result = T.StructType([T.StructField("lid", q.schema["lid"].dataType), T.StructField("rid", c.schema["rid"].dataType),
                           T.StructField("similarity", T.DoubleType())])
    arrow, table, n_min, n_max = to_arrow_schema(result), table_of(weights), weights.n_min, weights.n_max
    vectors = lambda rows: sparse_rows(rows, table(), n_min, n_max)

    def enter(some: pa.Table) -> tuple:
        return some.column("lid").to_pylist(), vectors(some), Best(some.num_rows, k)

    def meet(state: tuple, rows: pa.Table) -> None:
        lid, asked, best = state
        index, rid = SparseBlock.packed(*vectors(rows)), rows.column("rid").to_pylist()
        tie = id_order(np.array(rid, dtype=object))
        own: dict = {}
        for j, r in enumerate(rid if exclude_same else ()):
            own.setdefault(r, []).append(j)
        for first, *some in slices(*asked, visitors):
            near, margin = index.near_packed(*some)
            for i in range(len(near) if exclude_same else 0):
                near[i, own.get(lid[first + i], [])] = -np.inf
            best.offer_near(first, near, margin, partial(index.exact, *some), rid, tie)

    def leave(state: tuple) -> Iterator[pa.RecordBatch]:
        lid, _, best = state
        rows = [(one, r, -s) for one, held in zip(lid, best.rows) for s, _, r, _ in held]
        for a in range(0, len(rows), MOST_VISITS):
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[a:a + MOST_VISITS]), arrow)],
                                             schema=arrow)

    return _merged(cross_blocks(c, "rid", q, "lid", enter, meet, leave, result, block_rows), q_key, c_key, k)


def id_order(ids: np.ndarray) -> np.ndarray:
    """Position of every id in ascending id order, nulls first (for tie-breaks in numpy)."""
    if ids.dtype == object:
        null = np.array([x is None for x in ids], dtype=bool)
        out = np.empty(len(ids), dtype=np.int64)
        out[null] = np.arange(null.sum())
        out[~null] = null.sum() + np.argsort(np.argsort(ids[~null], kind="stable"), kind="stable")
        return out
    return np.argsort(np.argsort(ids, kind="stable"), kind="stable")


def _unit(rows: pa.Table) -> np.ndarray:
    values, sizes = lists_to_numpy(rows.column("v"), "float64")
    m = values.reshape(len(sizes), -1)
    return m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), 1e-12, None)


class Cells(NamedTuple):
    """Pivot cells: contexts with their block and pack of blocks, each block's pivot, least and largest angle to it, and
    size, and the number of packs."""

    rows: DataFrame
    pivots: np.ndarray
    pivot: np.ndarray
    least: np.ndarray
    most: np.ndarray
    size: np.ndarray
    packs: int


#: Pivots at most, and blocks whose angles are kept on the driver.
MOST_PIVOTS, MOST_BLOCKS = 512, 1 << 17
#: Rows of a pack of blocks, about.
PACK_ROWS = 4096


def pivot_cells(c: DataFrame, block_rows: int) -> Cells:
    """Contexts (rid, v) in blocks of about ``block_rows``, alike in direction: a shell round the nearest of some pivots.

    Pivots are the contexts smallest by a hash, one for each block wanted up to ``MOST_PIVOTS``.
    """
    n = c.count()
    wanted = max(1, min(MOST_PIVOTS, -(-n // block_rows)))
    first = c.select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).toArrow()
    pivots = _unit(first)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = np.clip(_unit(pa.Table.from_batches([batch])) @ pivots.T, -1, 1)
            cell = cos.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(np.arccos(cos[np.arange(len(cell)), cell]))],
                names=[*batch.schema.names, "cell", "angle"])

    placed = c.mapInArrow(nearest, T.StructType(c.schema.fields + [T.StructField("cell", T.IntegerType()),
                                                                   T.StructField("angle", T.DoubleType())]))
    placed = range_number(placed, ["cell"], [F.col("angle").asc(), F.col("rid").asc()], "_n")
    block = F.col("cell").cast("long") * (1 << 40) + F.floor((F.col("_n") - 1) / block_rows)
    placed = materialize(placed.withColumn("block", block).drop("_n"))
    about = (placed.groupBy("block", "cell").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1)))
             .orderBy("block").toPandas())  # a row for each block
    if len(about) > MOST_BLOCKS:
        raise ValueError(f"{len(about)} blocks; take larger ones than {block_rows} rows")
    pivot, least, most, size = (about.iloc[:, k].to_numpy() for k in (1, 2, 3, 4))
    pack = np.unique((np.cumsum(size) - size) // max(PACK_ROWS, block_rows), return_inverse=True)[1]  # numbered without gaps
    numbers = [(int(b), i, int(pack[i])) for i, b in enumerate(about["block"])]
    lookup = placed.sparkSession.createDataFrame(numbers or [(0, 0, 0)], "block long, _block long, _pack long")
    rows = (placed.join(F.broadcast(lookup), "block").drop("block", "cell", "angle")
            .withColumnRenamed("_block", "block"))
    return Cells(rows, pivots, pivot, least, most, size, int(pack.max(initial=0)) + 1)


#: Visits, or rows of the best, at most that a worker gives out at once.
MOST_VISITS = 1 << 14


def _slack(width: int) -> float:
    """Angles of vectors of ``width`` values are told no worse."""
    return 4 * np.sqrt(2 * (width + 8) * np.finfo(np.float64).eps)


def _first_visits(q: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Questions (lid, v) with a row for each block that they see first: those of the best bounds that hold k + 1
    contexts together.

    The bound of a block is the cosine of the least angle that the triangle inequality leaves between the question and
    any row of the block.
    """
    _, pivots, pivot, least, most, size, _ = cells
    slack = _slack(pivots.shape[1])

    def seen(unit: np.ndarray) -> np.ndarray:
        angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))[:, pivot]
        apart = np.maximum(np.maximum(angle - most, least - angle) - slack, 0)
        order = np.argsort(apart, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        early = np.zeros(apart.shape, dtype=bool)
        np.put_along_axis(early, order, before <= k, axis=1)
        return early

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // len(size))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                some = batch.slice(a, step)
                row, block = np.nonzero(seen(_unit(pa.Table.from_batches([some]))))
                for b in range(0, len(row), MOST_VISITS):
                    part = some.select(["lid", "v"]).take(pa.array(row[b:b + MOST_VISITS]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block[b:b + MOST_VISITS], pa.int64())],
                                                     names=["lid", "v", "block"])

    schema = T.StructType([q.schema["lid"], q.schema["v"], T.StructField("block", T.LongType())])
    return q.mapInArrow(run, schema)


def _best_of_cells(q: DataFrame, cells: Cells, k: int, exclude_same: bool, visitors: int, result: T.StructType,
                   visits: Accumulator) -> DataFrame:
    """The k best contexts of each question (lid, v, floor), some of them several times, once for each task that saw it.

    A part of the questions meets the packs of blocks in a task; of a pack a question sees the blocks whose bound
    reaches its k-th similarity so far, ``floor`` at first.  Both sides are written once, and no visit is.
    """
    _, pivots, pivot, least, most, _, packs = cells
    slack, arrow = _slack(pivots.shape[1]), to_arrow_schema(result)

    def enter(some: pa.Table) -> tuple:
        unit, best = _unit(some), Best(some.num_rows, k)
        best.floor[:] = some.column("floor").to_numpy() - 1.5 * 10.0 ** -SCORE_PLACES  # scores may round differently here
        return some.column("lid").to_pylist(), unit, np.arccos(np.clip(unit @ pivots.T, -1, 1)), best

    def meet(state: tuple, rows: pa.Table) -> None:
        lid, unit, angles, best = state
        rows = rows.sort_by("block")
        block, rid, others = rows.column("block").to_numpy(), rows.column("rid").to_pandas().to_numpy(), _unit(rows)
        tie, edges = id_order(rid), [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for first in range(0, len(lid), visitors):
            part = slice(first, first + visitors)
            scores = np.full((len(lid[part]), len(block)), -np.inf)
            for a, b in zip(edges, edges[1:]):
                i = block[a]
                angle = angles[part, pivot[i]]
                apart = np.maximum(np.maximum(angle - most[i], least[i] - angle) - slack, 0)
                sees = np.flatnonzero(np.cos(apart) >= best.floor[part] - 10.0 ** -SCORE_PLACES)
                scores[sees, a:b] = np.round(unit[part][sees] @ others[a:b].T, SCORE_PLACES)
                visits.add(len(sees))
            if exclude_same:
                for i, own in enumerate(lid[part]):
                    scores[i, rid == own] = -np.inf
            best.offer(first, scores, rid, tie)

    def leave(state: tuple) -> Iterator[pa.RecordBatch]:
        rows = [(one, r, -s) for one, held in zip(state[0], state[3].rows) for s, _, r, _ in held]
        for a in range(0, len(rows), MOST_VISITS):
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[a:a + MOST_VISITS]), arrow)],
                                             schema=arrow)

    return cross_blocks(cells.rows, "rid", q, "lid", enter, meet, leave, result, packs=packs)


def topk_dense(questions: DataFrame, contexts: DataFrame, q_key: str, c_key: str, vec: str, k: int,
               exclude_same: bool = False, block_rows: int = 8192, visitors: int = 1024) -> DataFrame:
    """T8 + K1: cosine with norms floored at 1e-12, top k per question
    (similarity desc, context key asc).  Output (q_key, c_key, similarity, pos).

    Contexts lie in pivot cells; a question first visits the nearest blocks,
    then all whose triangle-inequality bound reaches its k-th similarity, so
    that blocks which cannot hold one of the k are left out.  The number of
    these visits is logged; they are never written, as their number may grow
    with the square of the rows.  Vectors have one length and no nulls.
    """
    q = materialize(questions.select(F.col(q_key).alias("lid"), F.col(vec).alias("v")))
    c = materialize(contexts.select(F.col(c_key).alias("rid"), F.col(vec).alias("v")))
    result = _result_schema(q, c)
    if c.isEmpty():
        return q.sparkSession.createDataFrame([], result).select(
            F.col("lid").alias(q_key), F.col("rid").alias(c_key), "similarity", F.lit(0).alias("pos"))
    arrow, cells = to_arrow_schema(result), pivot_cells(c, block_rows)

    def hold(rows: pa.Table) -> tuple:
        rid = rows.column("rid").to_pandas().to_numpy()
        return _unit(rows), rid, id_order(rid)

    def meet(held: tuple, some: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, rid, tie = held
        for a in range(0, some.num_rows, visitors):
            part = some.slice(a, visitors)
            lid = part.column("lid").to_pylist()
            yield pa.RecordBatch.from_pydict(_top_rows(_unit(part) @ unit.T, lid, rid, tie, k, exclude_same), arrow)

    first = cells.rows.drop("_pack")
    near = materialize(visit_blocks(first, _first_visits(q, cells, k), hold, meet, result))
    if len(cells.size) == 1:
        return _merged(near, q_key, c_key, k)
    floors = (_merged(near, "lid", "rid", k).where(F.col("pos") == k)
              .select("lid", F.col("similarity").alias("floor")))
    asked = q.join(floors, "lid", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    visits = q.sparkSession.sparkContext.accumulator(0)
    best = materialize(_merged(_best_of_cells(asked, cells, k, exclude_same, visitors, result, visits), q_key, c_key, k))
    _log.info("%d visits to %d blocks", visits.value, len(cells.size))
    return best
