"""Conflict-constrained best-fit packing of documents into sequences of bounded length.

A bin holds at most ``capacity`` words, at most one piece of each source and
at most one piece of each duplicate cluster.  Texts above the capacity are cut
into pieces first.  Documents are dealt by hash into groups of bounded size,
and each group is packed in one task, longest piece first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankscope.llm.common import materialize, text_key
from rankscope.llm.quality import WORD_BREAK

CAPACITY = 2048
GROUP_ROWS = 4096
#: Copies of a row that are written out at a time.
_COPIES = 10_000


class ResidualTree:
    """Bins ordered by residual; every node has the intersection of the bitmaps of the bins below it.

    A node whose intersection shares a bit with a piece holds no bin for it,
    so the successor search passes over it whole.
    """

    NONE = -1  # all bits: nothing fits into no bin

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.common = [self.NONE] * (2 * self.size)
        self.bins: list[dict[int, list[int]]] = [{} for _ in range(self.size)]

    def _refresh(self, residual: int, value: int) -> None:
        i = residual + self.size
        while i and self.common[i] != value:
            self.common[i] = value
            i //= 2
            if i:
                value = self.common[2 * i] & self.common[2 * i + 1]

    def add(self, residual: int, bitmap: int, number: int) -> None:
        self.bins[residual].setdefault(bitmap, []).append(number)
        self._refresh(residual, self.common[residual + self.size] & bitmap)

    def take(self, length: int, bitmap: int) -> tuple[int, int, int] | None:
        """Removes and returns (residual, bitmap, number) of the tightest compatible bin."""
        i, todo = length + self.size, []
        while True:  # the nodes that cover the residuals from length on, left to right
            todo.append(i)
            while i & 1:
                i //= 2
            if i == 0:
                break
            i += 1
        todo.reverse()
        while todo:
            i = todo.pop()
            if self.common[i] & bitmap:
                continue
            if i < self.size:
                todo += [2 * i + 1, 2 * i]
                continue
            leaf = self.bins[i - self.size]
            for own, numbers in leaf.items():
                if not own & bitmap:
                    number = numbers.pop()
                    if not numbers:
                        del leaf[own]
                        value = self.NONE
                        for x in leaf:
                            value &= x
                        self._refresh(i - self.size, value)
                    return i - self.size, own, number
        return None


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, placed in the given order into the tightest compatible bin or a new one."""
    bit_of: dict = {}
    repeated = pd.Series(clusters).duplicated(keep=False).to_numpy()
    tree, places, made = ResidualTree(capacity), [], 0
    for length, source, cluster, twice in zip(lengths, sources, clusters, repeated):
        bitmap = 1 << bit_of.setdefault(("source", source), len(bit_of))
        if twice:
            bitmap |= 1 << bit_of.setdefault(("cluster", cluster), len(bit_of))
        found = tree.take(length, bitmap)
        if found is None:
            residual, own, number = capacity, 0, made
            made += 1
        else:
            residual, own, number = found
        places.append((number, capacity - residual))
        tree.add(residual - length, own | bitmap, number)
    return places


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         cluster_col: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS,
         clusters: DataFrame | None = None) -> DataFrame:
    """One row per piece: id, text_key, piece, n_pieces, first_word, n_words, bin_id, bin_offset, bin_words.

    id and text_key (``common.text_key``) lead back to the text, whose words
    from first_word on are the piece.

    Lengths are words between ASCII white space; ``cluster_col`` names the
    duplicate cluster, or ``clusters`` gives that of each text as (key,
    cluster), key being ``common.text_key``; by default it is the exact text.
    A null or empty text is one piece of no words, which takes a place in a bin
    like any other; a null source or cluster is a value of its own; repeated
    rows are pieces of one cluster and go to different bins, dealt over all
    groups; an empty table gives an empty one.  Bins belong to one group:
    ``bin_id`` is the group's number times 2^32 plus the bin's.  More groups
    than one cost part of a bin each.  Other columns are not read.
    """
    if capacity < 1 or group_rows < 1:
        raise ValueError("capacity and group_rows must be positive")
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), WORD_BREAK), ""))
    cluster = text_key(text_col) if cluster_col is None else F.md5(F.coalesce(
        F.concat(F.lit("="), F.col(cluster_col).cast("string")), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       cluster.alias("cluster"), text_key(text_col).alias("key"), words.cast("long").alias("len"))
    kinds = rows.groupBy("id", "source", "cluster", "key", "len").agg(F.count(F.lit(1)).alias("copies"))
    if clusters is not None:  # nothing after the join needs a text's rows together, so that Spark can split them
        own = clusters.select(F.col("key"), F.md5(F.concat(F.lit("="), "cluster").cast("binary")).alias("own"))
        kinds = kinds.join(own, "key", "left").withColumn("cluster", F.coalesce("own", "cluster")).drop("own")
    kinds = materialize(kinds)
    groups = max(1, -(-(kinds.agg(F.sum("copies")).first()[0] or 0) // group_rows))
    # equal rows are interchangeable, so their number can tell them apart; some thousands of them are written out at a time
    last = F.col("copies") - 1
    rows = (kinds.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(_COPIES).cast("long"))))
            .repartition("id", "key", "from")
            .withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (_COPIES - 1), last)))))
    dealt = F.when(F.col("copy") == 0, F.xxhash64("id", "key")).otherwise(F.xxhash64("id", "key", "copy"))
    rows = (rows.withColumn("group", F.pmod(dealt, F.lit(groups)))
            .withColumn("n_pieces", F.greatest(F.ceil(F.col("len") / capacity), F.lit(1)))
            .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)))
            .withColumn("first_word", F.col("piece") * capacity)
            .withColumn("n_words", F.least(F.col("len") - F.col("first_word"), F.lit(capacity)).cast("long")))
    id_type = rows.schema["id"].dataType.simpleString()

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "id", "key", "piece"], ascending=[False, True, True, True],
                              kind="stable", na_position="last")
        source = [s if isinstance(s, str) else None for s in pdf["source"]]
        places = best_fit(pdf["n_words"].tolist(), source, pdf["cluster"].tolist(), capacity)
        pdf["bin_id"] = [int(b) for b, _ in places] + pdf["group"] * (1 << 32)
        pdf["bin_offset"] = [o for _, o in places]
        pdf["bin_words"] = pdf.groupby("bin_id")["n_words"].transform("sum")
        return pdf[["id", "key", "piece", "n_pieces", "first_word", "n_words", "bin_id", "bin_offset", "bin_words"]].rename(
            columns={"key": "text_key"})

    return (rows.select("group", "id", "key", "source", "cluster", "n_pieces", "piece", "first_word", "n_words")
            .groupBy("group").applyInPandas(
                pack_group, f"id {id_type}, text_key string, piece long, n_pieces long, first_word long, n_words long, "
                            "bin_id long, bin_offset long, bin_words long"))
