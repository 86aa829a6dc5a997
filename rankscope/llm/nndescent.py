"""Embedding near-dedup by NN-descent.

A neighbour graph of bounded lists starts from rows that lie together in
several random hyperplane orders, and is refined by joins of the neighbours of
neighbours: each vector meets its neighbours' and reverse neighbours' vectors
in one group, and pairs that improve a list are kept.  The graph's links are
audited against brute force on a sample that holds enough linked vectors, and
rounds, each with fresh orders besides the joins, go on until the audit is
content; where rounds no longer bring it nearer, all vectors are compared, in
blocks.  Lists that are full of links are saturated: they are enlarged and
audited in the same way, and the components that still hold saturated lists
are compared whole, in blocks, so that no list length limits the result.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankscope.llm.common import connected_components, materialize
from rankscope.operators.ranking import range_number
from rankscope.session import bounded_broadcast, num_partitions

THRESHOLD = 0.9
K, LARGE_K = 10, 40
ORDERS, BITS, RUN = 8, 24, 128
#: Vectors up to which ORDERS orders do, and the power of the table's size by which more are taken above: a pair at
#: cosine 0.9 agrees on a hyperplane's sign with probability 0.856, and an order must agree on a bit more per doubling.
ORDERS_ROWS, ORDERS_POWER = 40_000, 0.224
#: Vectors of the audit's first sample, linked vectors it must hold (else it grows), and its largest size; target recall.
AUDIT_ROWS, AUDIT_LINKED, AUDIT_MOST, AUDIT_RECALL = 1024, 256, 65_536, 0.97
#: Rounds that must together close the given share of the gap to the target; else all vectors are compared.
STALL_ROUNDS, STALL_SHARE = 3, 0.1
BLOCK, WHOLE_BLOCK = 256, 2048

_log = logging.getLogger(__name__)


def _unit(vecs: pd.Series, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), dtype="<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec): vec is the doubles' bytes, shorter vectors filled up with zeros, null for vectors without direction."""
    dim = df.agg(F.max(F.size(vec_col))).first()[0] or 0

    @F.pandas_udf("binary")
    def pack(arrays: pd.Series) -> pd.Series:
        out = []
        for a in arrays:
            x = np.zeros(dim)
            if a is not None and len(a):
                x[:len(a)] = np.array([np.nan if v is None else v for v in a], dtype=np.float64)
            out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
        return pd.Series(out)

    vec = F.col(vec_col).cast("array<double>")
    return df.select(F.col(id_col).alias("id"), pack(vec).alias("vec")), dim


def _by_group(key: str, work: Callable[[pd.DataFrame], pd.DataFrame], rows: int = 20_000):
    """mapInPandas body over partitions sorted by ``key``: ``work`` gets whole groups, many at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= rows:
                whole = pd.concat(held, ignore_index=True)
                tail = whole[key] == whole[key].iloc[-1]
                if not tail.all():
                    yield work(whole[~tail])
                held = [whole[tail].reset_index(drop=True)]
                n = len(held[0])
        if n:
            yield work(pd.concat(held, ignore_index=True))

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each v; ``new`` marks those not listed before."""
    one = rows.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    order = Window.partitionBy("v").orderBy(F.col("sim").desc(), "u")
    return materialize(one.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"))


def _orders(n: int) -> int:
    """Hyperplane orders for ``n`` vectors."""
    return round(ORDERS * max(1.0, (n / ORDERS_ROWS) ** ORDERS_POWER))


def _near_in_orders(nodes: DataFrame, dim: int, k: int, seed: int | list[int], orders: int) -> DataFrame:
    """(v, u, sim, new): the k nearest within runs of RUN rows, in each of ``orders`` orders by hyperplane signs."""

    @F.pandas_udf("array<long>")
    def codes(vecs: pd.Series) -> pd.Series:
        planes = np.random.default_rng(seed).normal(size=(dim, orders * BITS))
        signs = (_unit(vecs, dim) @ planes > 0).reshape(len(vecs), orders, BITS)
        return pd.Series(list((signs * (1 << np.arange(BITS - 1, -1, -1))).sum(axis=2)))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, run = _unit(pdf["vec"], dim), pdf["node"].to_numpy(), pdf["run"].to_numpy()
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        return pd.concat([nearest(x[p:q], ids[p:q]) for p, q in zip(starts, np.r_[starts[1:], len(run)])])

    def nearest(x: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        top = np.argsort(-sim, axis=1, kind="stable")[:, :min(k, len(ids) - 1)]
        got = np.take_along_axis(sim, top, axis=1)
        return pd.DataFrame({"v": np.repeat(ids, top.shape[1]), "u": ids[top].ravel(), "sim": got.ravel(), "new": True})

    # runs are cut by place in the whole order, wherever partitions begin
    rows = nodes.select("node", F.posexplode(codes("vec")).alias("order", "code"))
    placed = range_number(rows, ["order"], [F.col("code").asc(), F.col("node").asc()], "place")
    run = F.col("order").cast("long") * (1 << 40) + F.floor((F.col("place") - 1) / RUN)
    dealt = (placed.select("node", run.alias("run")).join(nodes.select("node", "vec"), "node")
             .repartition(num_partitions(nodes.sparkSession), "run").sortWithinPartitions("run", "node"))
    return dealt.mapInPandas(_by_group("run", near), "v long, u long, sim double, new boolean")


def _candidates(lists: DataFrame, nodes: DataFrame, dim: int, k: int, round_no: int,
                only: DataFrame | None = None, floor: float = -1.0) -> DataFrame:
    """Pairs (v, u, sim) among the neighbours and reverse neighbours of each vector that improve a list.

    Of the reverse neighbours of a hub ``k`` are drawn in each round, by hash.
    """
    back = lists.select(F.col("u").alias("v"), F.col("v").alias("u"), "new")
    draw = Window.partitionBy("v").orderBy(F.xxhash64("v", "u", F.lit(round_no)))
    back = back.withColumn("_r", F.row_number().over(draw)).where(F.col("_r") <= k).drop("_r")
    members = lists.select("v", "u", "new").union(back).groupBy("v", "u").agg(F.max("new").alias("new"))
    if only is not None:
        members = members.join(only, "v", "left_semi")
    last = materialize(lists.groupBy(F.col("v").alias("u")).agg(F.min("sim").alias("last"),
                                                                F.count(F.lit(1)).alias("n")))
    ends = nodes.withColumnRenamed("node", "u").join(last, "u", "left").select(
        "u", "vec", F.when(F.col("n") >= k, F.greatest("last", F.lit(floor))).otherwise(floor).alias("last"))
    # written before the join, so that Spark can split the rows of a vector that very many lists hold
    rows = members.join(materialize(ends), "u")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pd.factorize(pdf["v"])[0]
        place = pdf.groupby("v", sort=False).cumcount().to_numpy()
        x, ids = _unit(pdf["vec"], dim), pdf["u"].to_numpy()
        new, last = pdf["new"].to_numpy(dtype=bool), pdf["last"].to_numpy()
        out = []
        wide = int(place.max()) + 1
        step = max(1, 2_000_000 // (wide * max(wide, dim)))
        for a in range(0, int(group.max()) + 1, step):
            mine = (group >= a) & (group < a + step)
            at = (group[mine] - a, place[mine])
            box = np.zeros((step, wide, dim))
            box[at] = x[mine]
            no, fresh, low = (np.full((step, wide), -1), np.zeros((step, wide), bool), np.full((step, wide), 3.0))
            no[at], fresh[at], low[at] = ids[mine], new[mine], last[mine]
            sim = box @ box.transpose(0, 2, 1)
            pair = (sim > low[:, :, None]) & (fresh[:, :, None] | fresh[:, None, :])
            pair &= (no[:, :, None] != no[:, None, :]) & (no[:, None, :] >= 0)
            g, i, j = np.nonzero(pair)
            out.append(pd.DataFrame({"v": no[g, i], "u": no[g, j], "sim": sim[g, i, j]}))
        return pd.concat(out).drop_duplicates(["v", "u"])

    parts = num_partitions(nodes.sparkSession)
    return (rows.repartition(parts, "v").sortWithinPartitions("v")
            .mapInPandas(_by_group("v", work), "v long, u long, sim double"))


def links_of(lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b of the listed pairs that reach the threshold."""
    near = lists.where(F.col("sim") >= threshold)
    return near.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()


def linked_sample(nodes: DataFrame, dim: int, threshold: float, n: int) -> DataFrame:
    """(q, n): the links by brute force over all vectors, of those with links among the vectors smallest by hash.

    The sample grows until AUDIT_LINKED of its vectors have links, up to
    AUDIT_MOST vectors or the whole table.
    """
    rows = AUDIT_ROWS
    while True:
        asked = nodes.orderBy(F.xxhash64("node", F.lit(17))).limit(rows).select("node", "vec").toPandas()  # bounded
        ids = asked["node"].to_numpy()
        x = _unit(asked["vec"], dim) if len(ids) else np.zeros((0, dim))

        def near(batches: Iterator[pd.DataFrame], x: np.ndarray = x, ids: np.ndarray = ids) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                y, far = _unit(pdf["vec"], dim), pdf["node"].to_numpy()
                for a in range(0, len(ids), 2048):
                    found = y @ x[a:a + 2048].T >= threshold
                    found &= far[:, None] != ids[None, a:a + 2048]
                    n = found.sum(axis=0)
                    yield pd.DataFrame({"q": ids[a:a + 2048][n > 0], "n": n[n > 0]})

        true = (nodes.select("node", "vec").mapInPandas(near, "q long, n long")
                .groupBy("q").agg(F.sum("n").alias("n")))
        true = materialize(true)
        if rows >= min(n, AUDIT_MOST) or true.count() >= AUDIT_LINKED:
            return true
        rows *= 4


def audit(true: DataFrame, links: DataFrame, most: int) -> tuple[int, int]:
    """(links found, links there are) of the sample's vectors; of each vector at most ``most`` links count as there.

    Saturated vectors' lists, which hold no more, are completed later.
    """
    ends = links.select(F.col("a").alias("q")).union(links.select("b"))
    found = ends.groupBy("q").agg(F.count(F.lit(1)).alias("f"))
    row = (true.join(found, "q", "left")
           .agg(F.sum(F.least("n", F.lit(most))),
                F.sum(F.least(F.coalesce("f", F.lit(0)), F.least("n", F.lit(most)))))).first()
    return int(row[1] or 0), int(row[0] or 0)


def _block_counts(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, weight): for members (comp, n, node, size, vec) the sizes of all others of their component they link with."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = (members.withColumn("nb", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine",
                    "node", "size", "vec"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x, size, mine = _unit(pdf["vec"], dim), pdf["size"].to_numpy(), pdf["mine"].to_numpy()
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if not same:
            near &= mine[:, None] != mine[None, :]
        return pd.DataFrame({"node": pdf["node"].to_numpy(), "weight": near @ size})

    return (rows.groupBy("comp", "i", "j").applyInPandas(count, "node long, weight long")
            .groupBy("node").agg(F.sum("weight").alias("weight")))


def _compare_whole(nodes: DataFrame, dim: int, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Over all pairs of ``nodes`` (node, size, vec): (a, b) that connect what links connect, and (node, weight).

    Rows are dealt by hash to blocks, and each pair of blocks is a task; a
    task emits one connection and one weight per row, never its pairs.
    """
    blocks = max(1, -(-n // WHOLE_BLOCK))
    rows = (nodes.select("node", "size", "vec", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("mine"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .select(F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine",
                    "node", "size", "vec"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, mine = _unit(pdf["vec"], dim), pdf["mine"].to_numpy()
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            near &= mine[:, None] != mine[None, :]
        some = np.flatnonzero(near.any(axis=1))
        near, ids, size = near[np.ix_(some, some)], pdf["node"].to_numpy()[some], pdf["size"].to_numpy()[some]
        low = np.arange(len(some))
        while len(some):
            least = np.minimum(low, np.where(near, low[None, :], len(some)).min(axis=1))
            least = least[least]
            if (least == low).all():
                break
            low = least
        return pd.DataFrame({"a": ids, "b": ids[low], "weight": near @ size})

    made = materialize(rows.groupBy("i", "j").applyInPandas(compare, "a long, b long, weight long"))
    return (made.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            made.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("weight")))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    k: int = K, large_k: int = LARGE_K, seed: int = 7) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept, recall.

    n_links counts the other rows found within cosine ``threshold``;
    component_id is the smallest id that links reach; kept: the id is it;
    recall: the share of the audited sample's links that were found, the same
    on every row, 1 where all pairs were compared, null where the largest
    sample had no link to find, so that it is unmeasured.
    Vectors that are null, zero, or hold a null or non-finite component link
    with nothing (component_id is their own id); shorter vectors are filled up
    with zeros; equal vectors, repeated rows included, are one node of the
    graph and link with each other; a null id is never the smallest one and
    never kept; an empty table gives an empty one.
    """
    rows, dim = _packed(df, id_col, vec_col)
    rows = materialize(rows)
    whole = rows.where("vec is not null")
    classes = whole.groupBy("vec").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("min_id"))
    # numbered by a hash of the vector, so that the same vectors have the same numbers on any cluster
    nodes = materialize(range_number(classes, [], [F.xxhash64("vec").asc(), F.col("vec").asc()], "node"))
    edges, dense, counted, recall = _graph(nodes, dim, threshold, k, large_k, seed)
    comp = materialize(connected_components(edges, "a", "b"))
    named = (nodes.join(comp, "node", "left")
             .select("node", "vec", "size", "min_id", F.coalesce("component", "node").alias("comp")))
    named = materialize(named)
    if counted is None:
        full = named.join(dense, "node", "left_semi").select("comp").distinct()
        sizes = materialize(named.join(full, "comp", "left_semi").groupBy("comp").agg(F.count(F.lit(1)).alias("n")))
        members = named.join(bounded_broadcast(sizes), "comp")
        counted = _block_counts(members, dim, threshold)
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    size_of = nodes.select(F.col("node").alias("other"), "size")
    listed = (both.join(size_of, "other").groupBy("node").agg(F.sum("size").alias("listed")))
    low = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    result = (named.select("node", "vec", "size", "comp").join(low, "comp")
              .join(counted, "node", "left").join(listed, "node", "left")
              .select("vec", "component_id",
                      (F.col("size") - 1 + F.coalesce("weight", "listed", F.lit(0))).cast("long").alias("n_links")))
    result = materialize(result)
    joined = whole.join(result, "vec").select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("id").alias("component_id"))
    return (joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
            .withColumn("recall", F.lit(recall).cast("double")))


def _graph(nodes: DataFrame, dim: int, threshold: float, k: int, large_k: int,
           seed: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, float | None]:
    """Links (a, b), the nodes whose enlarged lists are still full of links, None, and the audited recall.

    Where rounds stall below AUDIT_RECALL: connections (a, b), None, the
    weights (node, weight) of all nodes with links, by comparing all pairs, and 1.
    """
    recall: float | None = None
    vecs = nodes.select("node", "vec")
    n = nodes.count()
    orders = _orders(n)
    true = linked_sample(vecs, dim, threshold, n)

    def refine(lists: DataFrame, size: int, first: int, only: DataFrame | None = None,
               floor: float = -1.0) -> tuple[DataFrame, DataFrame, int, bool]:
        """(lists, links, next round, whether the audit is content) after rounds with lists of ``size``."""
        nonlocal recall
        known: list[int] = []
        number = first
        while True:
            more = _candidates(lists, vecs, dim, size, number, only, floor).withColumn("new", F.lit(True))
            if known:
                more = more.union(_near_in_orders(vecs, dim, size, [seed, number], orders))
            lists = _best(more.union(lists.select("v", "u", "sim", F.lit(False))), size)
            edges = materialize(links_of(lists, threshold))
            found, there = audit(true, edges, size)
            recall = found / there if there else 1.0 if n <= AUDIT_MOST else None
            _log.info("round %d, lists of %d: %d of %d audited links found", number, size, found, there)
            known.append(found)
            number += 1
            if found >= AUDIT_RECALL * there:
                return lists, edges, number, True
            before = known[-1 - STALL_ROUNDS] if len(known) > STALL_ROUNDS else None
            if before is not None and found - before < STALL_SHARE * (AUDIT_RECALL * there - before):
                return lists, edges, number, False

    lists = _best(_near_in_orders(vecs, dim, k, seed, orders), k)
    lists, edges, number, good = refine(lists, k, 0)

    def saturated(size: int) -> DataFrame:
        near = lists.where(F.col("sim") >= threshold).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        return materialize(near.where(F.col("n") >= size).select("v"))

    full = saturated(k)
    if good and not full.isEmpty():
        below = float(np.nextafter(threshold, -1))
        lists, edges, number, good = refine(lists.withColumn("new", F.lit(True)), large_k, number, full, below)
        full = saturated(large_k)
    if not good:
        _log.warning("rounds stall below a recall of %s: all %d vectors are compared", AUDIT_RECALL, n)
        edges, counted = _compare_whole(nodes, dim, threshold, n)
        return edges, None, counted, 1.0
    return edges, full.withColumnRenamed("v", "node"), None, recall
