"""Seeded, partition-independent sampling and splits.

A random draw is an order by ``md5(seed | salt | key)``: deterministic, the
same on every cluster size, and reproducible in other SQL engines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankscope.functions.text import format_id
from rankscope.operators.ranking import number_within, range_number, top_k
from rankscope.session import bounded_broadcast


#: Spark limits a ranked group before the shuffle up to this rank.
LIMITED = 1000


def hash_order(seed: int, salt: str, *keys: Column | str) -> Column:
    cols = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *cols))


def hash_int(seed: int, salt: str, *keys: Column | str) -> Column:
    """Non-negative 63-bit integer from the same md5 (first 15 hex digits)."""
    return F.conv(F.substring(hash_order(seed, salt, *keys), 1, 15), 16, 10).cast("long")


def stratified_targets(corpus: DataFrame, n: int, dept: str = "canonical_department") -> DataFrame:
    """X2 targets: n // d per department, remainder to the first departments by name."""
    if n <= 0:
        raise ValueError("number of questions must be positive")
    depts = corpus.select(dept).distinct()
    w = Window.orderBy(dept)
    return (depts.withColumn("_i", F.row_number().over(w) - 1)
            .withColumn("_d", F.count(F.lit(1)).over(Window.partitionBy()))
            .select(dept, (F.floor(F.lit(n) / F.col("_d")) +
                           F.when(F.col("_i") < F.lit(n) % F.col("_d"), 1).otherwise(0)).cast("int").alias("target")))


def two_department_targets(corpus: DataFrame, n: int, departments: Sequence[str],
                           dept: str = "canonical_department") -> DataFrame:
    """X1 targets: floor(n/2) for the first department, the rest for the second.

    A department that is short leaves its share to the other; too few rows in
    both raise.  Two numbers reach the driver.
    """
    if len(departments) != 2:
        raise ValueError("two departments expected")
    sizes = corpus.where(F.col(dept).isin(list(departments))).groupBy(dept).agg(F.count(F.lit(1)).alias("m"))
    have = {r[dept]: r["m"] for r in sizes.collect()}
    first, second = (have.get(d, 0) for d in departments)
    if first + second < n:
        raise ValueError(f"{n} rows wanted, the departments have {first + second}")
    a = min(first, n // 2)
    b = min(second, n - a)
    a = min(first, n - b)
    return corpus.sparkSession.createDataFrame(list(zip(departments, (a, b))), f"{dept} string, target long")


def sample_by_targets(corpus: DataFrame, targets: DataFrame, seed: int, key: str = "raw_id",
                      dept: str = "canonical_department") -> DataFrame:
    """Hash-ordered sample of ``target`` rows per department; a department with fewer rows raises.

    The number of departments is small and their targets are few numbers; a
    department's rows are limited before the shuffle while targets are small
    and numbered over a range sort above, so that none sits in one task.
    """
    tb = bounded_broadcast(targets)
    short = (corpus.groupBy(dept).agg(F.count(F.lit(1)).alias("_m")).join(tb, dept, "right")
             .where(F.coalesce(F.col("_m"), F.lit(0)) < F.col("target")).limit(5).collect())
    if short:
        raise ValueError(f"not enough rows for departments {[r[dept] for r in short]}")
    kmax = max(1, targets.agg(F.max("target")).first()[0] or 0)
    order = [hash_order(seed, "sample", key)]
    ids = corpus.join(tb, dept).select(dept, key, "target")
    ranked = top_k(ids, [dept], order, kmax, "_s") if kmax <= LIMITED else range_number(ids, [dept], order, "_s")
    chosen = ranked.where(F.col("_s") <= F.col("target")).select(key)
    return corpus.join(chosen, key, "left_semi")


def shuffle_ids(sampled: DataFrame, seed: int, prefix: str, width: int = 4, key: str = "raw_id") -> DataFrame:
    """X3 + P8: a hash shuffle numbers the questions 1..n and names them."""
    numbered = range_number(sampled, [], [hash_order(seed, "shuffle", key)], "qno")
    return numbered.withColumn("qid", format_id(prefix, F.col("qno"), width))


def split_by_qid(df: DataFrame, test_size: float, seed: int, qid: str = "qid") -> DataFrame:
    """(qid, split) with test = ceil(n * test_size) qids, chosen by hash order.

    Distinct qids are numbered by a range-partitioned counter, never by a
    single-task window, so the split scales with the number of qids.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    qids = df.select(qid).distinct()
    n = qids.count()
    n_test = int(-(-n * test_size // 1))
    numbered = range_number(qids, [], [hash_order(seed, "split", qid), F.col(qid)], "_o")
    return numbered.select(qid, F.when(F.col("_o") <= n_test, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def pool_positions(corpus: DataFrame, seed: int, salt: str, key: str = "raw_id",
                   dept: str = "canonical_department") -> DataFrame:
    """Number every department's rows 0..m-1 in hash order (skew-safe), with m."""
    pos = number_within(corpus, [dept], [hash_order(seed, salt, key)], "_p")
    sizes = corpus.groupBy(dept).agg(F.count(F.lit(1)).alias("pool_size"))
    # one row per department; broadcast after a size check (a department may
    # hold a large share of the rows, so never shuffle-join on it)
    return pos.withColumn("pool_pos", F.col("_p") - 1).drop("_p").join(bounded_broadcast(sizes), dept)
