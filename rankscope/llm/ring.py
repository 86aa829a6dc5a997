"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``vnodes`` points on a 64-bit ring; a key belongs to the next
point clockwise.  A shard takes keys until its load reaches (1 + epsilon) times
the mean; keys that find it full go on clockwise to the next shard.  All keys
of one arc meet the shards in the same order, so what each shard takes of each
arc follows from the arcs' loads alone: a table of shards x vnodes rows, which
no corpus enlarges.  The keys then find their shard by the running load within
their arc, which is counted over a range-partitioned sort.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankscope.llm.common import materialize, numbered
from rankscope.session import num_partitions

SHARDS = 8
VNODES = 64
EPSILON = 0.01


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) sorted by point; points are signed 64-bit hashes of (shard, number)."""
    points = {}
    for shard in range(shards):
        for k in range(vnodes):
            points.setdefault(struct.unpack("<q", xxhash.xxh64_digest(f"{shard}:{k}"))[0], shard)
    return sorted(points.items())


def shard_order(points: list[tuple[int, int]], arc: int) -> list[int]:
    """The distinct shards met clockwise from arc ``arc`` on (the arc's own first)."""
    return list(dict.fromkeys(points[(arc + k) % len(points)][1] for k in range(len(points))))


def flows(loads: dict[int, int], points: list[tuple[int, int]], shards: int,
          capacity: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """Per arc the pieces (from, to, shard) of its running load.

    In hop k each arc, in ring order, offers what is left of it to the k-th
    shard clockwise, which takes up to its capacity.
    """
    free = list(capacity)
    taken = {arc: 0 for arc in loads}
    out: dict[int, list[tuple[int, int, int]]] = {arc: [] for arc in loads}
    orders = {arc: shard_order(points, arc) for arc in loads}
    for hop in range(shards):
        for arc in sorted(loads):
            left = loads[arc] - taken[arc]
            if left <= 0 or hop >= len(orders[arc]):
                continue
            shard = orders[arc][hop]
            part = min(left, free[shard])
            if part > 0:
                out[arc].append((taken[arc], taken[arc] + part, shard))
                taken[arc] += part
                free[shard] -= part
    return out


def arc_of(hashed: Column, points: list[tuple[int, int]]) -> Column:
    """Number of the first point at or after a signed 64-bit hash, round the ring: a binary search."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(hashed <= points[mid][0], below(low, mid)).otherwise(below(mid + 1, high))

    return F.pmod(below(0, len(points)), F.lit(len(points)))


def _running(rows: DataFrame, group: str, order: list[str], weight: str) -> DataFrame:
    """Adds ``before`` (weight of the group's earlier rows) and ``rank`` (their number), groups of any size.

    Rows are sorted over the whole cluster by range; each partition's totals,
    at most one row per partition and group it holds, give the offsets.
    """
    parts = num_partitions(rows.sparkSession)
    dealt = (rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
             .withColumn("_part", F.spark_partition_id()))
    dealt = materialize(dealt)  # partition numbers must not change between the uses
    totals = dealt.groupBy(group, "_part").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_part", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    local = Window.partitionBy(group, "_part").orderBy(*order)
    mine = local.rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_wl", F.coalesce(F.sum(weight).over(mine), F.lit(0)))
            .withColumn("_nl", F.row_number().over(local) - 1)
            .join(offsets, [group, "_part"])
            .withColumn("before", F.col("_w0") + F.col("_wl")).withColumn("rank", F.col("_n0") + F.col("_nl"))
            .drop("_part", "_w0", "_n0", "_wl", "_nl"))


def assign_shards(items: DataFrame, key_col: str, size_col: str | None = None, shards: int = SHARDS,
                  vnodes: int = VNODES, epsilon: float = EPSILON) -> DataFrame:
    """``items`` plus home_shard (the ring's owner), shard and slot (gapless from 0 within the shard).

    The load is the number of items, or the sum of ``size_col``, a positive
    long.  A shard takes (1 + epsilon) times the mean, rounded up; with an
    epsilon of 0 the shares are whole numbers at most one apart, and by number
    of items every shard ends with just its share.  By size an item belongs to
    the shard that takes its first unit, so each arc of the ring may overrun
    by part of one item.  A null key hashes like a value of its own; items
    equal in key are ordered by size and are interchangeable if equal in both;
    an empty table gives an empty one.  With one shard more or less most keys
    keep their shard.
    """
    if shards < 1 or vnodes < 1 or epsilon < 0:
        raise ValueError("shards and vnodes must be positive, epsilon not negative")
    names = items.columns
    items, used = numbered(items, key_col, *([size_col] if size_col else []))
    key_col, size_col = used[0], used[1] if size_col else None
    points = ring_points(shards, vnodes)
    owner = F.array(*[F.lit(s) for _, s in points])
    rows = items.withColumn("_hash", F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(key_col).cast("string")),
                                                           F.lit(""))))
    rows = rows.withColumn("_arc", arc_of(F.col("_hash"), points))
    rows = materialize(rows.withColumn("_load", F.col(size_col).cast("long") if size_col else F.lit(1).cast("long")))
    loads = {r["_arc"]: r["w"] for r in rows.groupBy("_arc").agg(F.sum("_load").alias("w")).collect()}  # a row a point
    total = sum(loads.values())
    capacity = ([math.ceil((1 + epsilon) * total / shards)] * shards if epsilon else
                [total // shards + (s < total % shards) for s in range(shards)])
    pieces = [(arc, a, b, s) for arc, found in flows(loads, points, shards, capacity).items() for a, b, s in found]
    table = items.sparkSession.createDataFrame(pieces, "_arc int, _from long, _to long, shard int")
    placed = _running(rows, "_arc", ["_hash", key_col, "_load"], "_load")
    placed = (placed.join(F.broadcast(table), "_arc")  # shards x vnodes x shards rows at most
              .where((F.col("before") >= F.col("_from")) & (F.col("before") < F.col("_to"))))
    placed = materialize(placed.drop("_from", "_to", "before"))
    # Within an arc a shard's items follow each other, so a slot is the items of earlier arcs plus a difference.
    runs = placed.groupBy("shard", "_arc").agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_r0"))
    earlier = Window.partitionBy("shard").orderBy("_arc").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_s0", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (placed.join(F.broadcast(runs), ["shard", "_arc"])  # the same bound
            .withColumn("slot", (F.col("_s0") + F.col("rank") - F.col("_r0")).cast("long"))
            .withColumn("home_shard", F.get(owner, F.col("_arc")))
            .select(*items.columns, "home_shard", "shard", "slot").toDF(*names, "home_shard", "shard", "slot"))
