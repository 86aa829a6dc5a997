"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankscope.session import materialize

__all__ = ["connected_components", "materialize", "numbered", "read_table", "text_key"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... and the new names of ``used``.

    Operators that carry all columns work on these names, so that a column of
    the table can be called like one of the operator's own.
    """
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(u)] for u in used]


def text_key(text: str | Column) -> Column:
    """128-bit digest of a text, hex; a null text and an empty one get different keys."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.md5(c.cast("binary")), F.lit("null"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star steps over an edge table: every step
    is a map-side combined minimum per node and a join of the edges with these
    minima, so a node with very many links is split like any skewed join key.
    Each round is checkpointed; only two numbers a round reach the driver.
    Self links and repeated links are allowed; a link with a null end is no
    link; no links give an empty table.
    """
    e = (edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
         .where("u is not null and v is not null and u <> v").distinct())
    e = materialize(e)
    if e.isEmpty():
        return e.toDF("node", "component")

    def minima(links: DataFrame) -> DataFrame:
        return materialize(links.groupBy("u").agg(F.min("v").alias("m")))

    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large)
        low = minima(large)
        joined = large.join(low, "u")
        small = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(e.select("v", "v").distinct()))
