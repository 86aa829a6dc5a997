"""Running sums, minima and maxima over groups of any size (W1, W2, W4, prefix sums).

A window over a whole group puts the group into one task.  Here rows are
sorted over the cluster by range, so that a large group spreads over many
partitions; each (group, partition) piece is a window of its own, and the
totals of the pieces before it are carried in.  Only groups that span
partitions need a carry: each partition holds two of them at most, its first
and its last, so the table of carries is bounded by the number of partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankscope.session import materialize, num_partitions


class Scan(NamedTuple):
    """A running ``kind`` ("sum", "min" or "max") of ``value``; without the row itself unless ``inclusive``."""

    kind: str
    value: Column
    inclusive: bool = True


_STEPS = {"sum": F.sum, "min": F.min, "max": F.max}


def _joined(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    return (F.least if kind == "min" else F.greatest)(carry, local)  # both skip nulls


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], scans: Mapping[str, Scan],
            partitions: int | None = None) -> DataFrame:
    """``df`` plus a column for each of ``scans``, over ``keys`` in ``order``.

    Nulls add nothing; a minimum or maximum of no value is null and a sum 0.
    Null keys are a group of their own.  ``order`` should be total, else equal
    rows are taken in an arbitrary order.
    """
    unknown = {s.kind for s in scans.values()} - set(_STEPS)
    if unknown:
        raise ValueError(f"unknown scans {sorted(unknown)}")
    columns = df.columns
    group = [f"_key{i}" for i in range(len(keys))]
    values = {out: f"_value{i}" for i, out in enumerate(scans)}
    rows = df.withColumns({g: F.col(k) for g, k in zip(group, keys)} | {values[o]: s.value for o, s in scans.items()})
    ranged = [F.col(g).asc_nulls_first() for g in group] + list(order)
    parts = partitions or num_partitions(df.sparkSession)
    dealt = (rows.repartitionByRange(parts, *ranged) if ranged else rows).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt)  # the numbers of partitions must not change between the uses
    totals = dealt.groupBy(*group, "_part").agg(*[_STEPS[s.kind](values[o]).alias(values[o]) for o, s in scans.items()])
    pieces = Window.partitionBy(*group)
    before = pieces.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carries = (totals.withColumn("_pieces", F.count(F.lit(1)).over(pieces))
               .withColumns({f"_carry{i}": _STEPS[s.kind](values[o]).over(before) for i, (o, s) in enumerate(scans.items())})
               .where("_pieces > 1")
               .select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_of{g}") for g in group],
                       *[f"_carry{i}" for i in range(len(scans))]))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of{g}"))
    window = Window.partitionBy(*group, "_part").orderBy(*order)
    local = {f"_local{i}": _STEPS[s.kind](values[o]).over(
        window.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)) for i, (o, s) in enumerate(scans.items())}
    out = dealt.withColumns(local).join(F.broadcast(carries), same, "left")  # two rows a partition at most
    return out.select(*columns, *[_joined(s.kind, F.col(f"_carry{i}"), F.col(f"_local{i}")).alias(o)
                                  for i, (o, s) in enumerate(scans.items())])
