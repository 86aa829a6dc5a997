"""Ranking inside groups.

Two physical strategies give the same numbers:

* bounded groups: one hash exchange on the group keys + ``row_number`` window;
* hot groups (more rows than ``rankscope.hotGroupRows``): a range-partitioned
  sort on (keys, order) spreads one group over many tasks, each numbers its
  piece, and the counts of the pieces before are carried in (operators.scan).

Hot keys are found with a count of hash buckets, and of keys where a bucket
has many rows, so the common case costs one extra narrow aggregation and no
broadcast at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankscope.functions.numeric import nan_to_null
from rankscope.operators.scan import Scan, running
from rankscope.session import (DEFAULT_BROADCAST_ROWS, DEFAULT_HOT_GROUP_ROWS, DEFAULT_TASK_ROWS, conf_int, join_where_dealt,
                               materialize, num_partitions, spread)

SCORE_COLUMNS = ["qid", "context_id", "score", "rank", "method", "latency_ms"]


def hot_group_rows(spark: SparkSession) -> int:
    return conf_int(spark, "rankscope.hotGroupRows", DEFAULT_HOT_GROUP_ROWS)


def _hot_rows(df: DataFrame, hot_rows: int | None) -> int:
    return hot_group_rows(df.sparkSession) if hot_rows is None else hot_rows


def _window_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long"))


def range_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank",
                 partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """row_number over (keys order by order) without putting a group in one task.

    With no keys this is a dense global counter (W2) that never funnels the
    data through a single partition.  With ``weight`` (a non-negative integer
    column) the result is the inclusive running sum of weight instead.
    """
    step = (F.col(weight) if weight is not None else F.lit(1)).cast("long")
    numbered = running(df, keys, order, {"_number": Scan("sum", step)}, partitions)
    return numbered.withColumn(out, F.col("_number")).drop("_number")


#: Hash buckets in which rows are counted before groups are.
BUCKETS = 4096


def total_and_most(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[int, int]:
    """Number of rows, and of rows in the largest group, or a bound of it where that is not over ``limit``.

    Buckets of groups are counted first, which moves next to nothing.
    """
    for group in ([F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")], keys):
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
        if (most or 0) <= limit:
            break
    return total or 0, most or 0


def dealt_by(rows: DataFrame, keys: Sequence[str], sizes: DataFrame, dealt: bool = False,
             hot_rows: int | None = None) -> DataFrame:
    """``rows`` ready for several windows and aggregates by ``keys`` over the same rows.

    They are dealt by the keys in one exchange, which all branches share.
    Where a group of ``sizes`` (rows with the same keys) is hot they are written
    out instead, so that no task gets the whole group and each branch limits it
    before its own exchange.  ``dealt`` says that they are read from tables
    bucketed by one of the keys and need neither.
    """
    if dealt:
        return rows
    limit = _hot_rows(rows, hot_rows)
    if limit <= 0:
        return rows.repartition(*keys)
    total, most = total_and_most(sizes, keys, limit)
    if most > limit:
        return materialize(rows)
    out = spread(rows, total, *keys)
    return rows.repartition(*keys) if out is rows else out


def dealt_once(frames: Sequence[DataFrame], *keys: str) -> list[DataFrame]:
    """Each of ``frames`` dealt by ``keys``, for joins, windows and aggregates by them and others, which take the rows as
    they lie; or all as they are where a group of one is hot."""
    spark = frames[0].sparkSession
    limit = hot_group_rows(spark)
    sizes = [total_and_most(df, keys, limit) for df in frames]
    if max(most for _, most in sizes) > limit:
        return list(frames)
    join_where_dealt(spark)
    wanted = -(-sum(total for total, _ in sizes) // conf_int(spark, "rankscope.taskRows", DEFAULT_TASK_ROWS))
    return [df.repartition(max(wanted, num_partitions(spark)), *keys) for df in frames]


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank",
                  hot_rows: int | None = None, size_hint: DataFrame | None = None) -> DataFrame:
    """row_number() over (partition by keys order by order), skew-safe.

    ``hot_rows <= 0`` skips hot-key detection (for callers whose groups are
    bounded by construction, e.g. validated 1+h+r candidate groups).
    ``size_hint`` is a cheaper frame with the same key columns whose group
    counts bound the real ones from above (e.g. the raw rows before an
    expensive cleaning step); detection then never recomputes ``df``.
    """
    limit = _hot_rows(df, hot_rows)
    if limit <= 0 or not keys:
        return _window_number(df, keys, order, out) if keys else range_number(df, [], order, out)
    counted = size_hint if size_hint is not None else df
    total, most = total_and_most(counted, keys, limit)
    if most <= limit:
        return _window_number(spread(df, total, *keys), keys, order, out)
    hot = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)
    cap = conf_int(df.sparkSession, "rankscope.broadcastRows", DEFAULT_BROADCAST_ROWS)
    n_hot = hot.count()
    hot_side = F.broadcast(hot) if n_hot <= cap else hot
    cold = df.join(hot_side, list(keys), "left_anti")
    heavy = df.join(hot_side, list(keys), "left_semi")
    return _window_number(cold, keys, order, out).unionByName(range_number(heavy, keys, order, out))


def score_order(score: str = "score", tie: str = "context_id") -> list[Column]:
    """Score descending (NaN and null last), then tie column ascending."""
    return [nan_to_null(score).desc_nulls_last(), F.col(tie).asc_nulls_last()]


def rank_scores(df: DataFrame, method: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """Rank candidates inside each qid; 1, 2, 3 ... with no ties.

    ``df`` needs qid, context_id, score and (unless ``method`` is given) a
    method column; latency_ms defaults to 0.0.  Output: the six score columns.
    """
    if method is not None:
        df = df.withColumn("method", F.lit(method))
    if "latency_ms" not in df.columns:
        df = df.withColumn("latency_ms", F.lit(0.0))
    df = df.where(F.col("qid").isNotNull()).withColumn("score", F.col("score").cast("double"))
    ranked = number_within(df, ["method", "qid"], score_order(), "rank", hot_rows)
    return ranked.select(*SCORE_COLUMNS)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          out: str = "pos") -> DataFrame:
    """K1/K2: first k rows per group.  ``row_number() <= k`` is planned as a
    WindowGroupLimit, which also limits before the shuffle (skew-safe)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The top row per group (rank asc, score desc, then tie column)."""
    return top_k(df, keys, order, 1, "_first").drop("_first")
