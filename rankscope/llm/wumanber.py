"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every run of ``width`` words of a benchmark item is a pattern; an item of fewer
words is one.  Patterns of one length share a shift table over blocks of words:
it tells how far the search may move on from the block that it stands on, most
of all (length - block + 1) where no pattern holds the block.  A block that
ends patterns leads to their bucket, where those with the right first block are
compared word by word.

Documents are scanned where they lie, in one pass and without a shuffle: the
patterns are broadcast where their tables take ``MOST_BYTES`` at most, which is
checked.  A larger benchmark is dealt into blocks of that size, each scanned in
a pass of its own, and only what was found is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankscope.llm.common import materialize, numbered, text_key

WIDTH = 10
#: Words of a block; shorter patterns have blocks of their own length.
BLOCK = 3
#: Estimated bytes of the tables of one broadcast, and of a (pattern, item) pair besides twice the pattern's own.
MOST_BYTES, PAIR_BYTES = 64_000_000, 600
#: Digits, a-z (A-Z is lower-cased) and all beyond ASCII are parts of words; every other byte stands between them.
_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
               for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of UTF-8 ``text``; null has none."""
    return bytes(text or b"").translate(_BYTES).split()


class Tables:
    """Shift table and buckets of the patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key, left = words[end - self.block:end], length - end
                if left < self.shift.get(key, self.most):
                    self.shift[key] = left
            bucket = self.buckets.setdefault(words[-self.block:], {})
            bucket.setdefault(words[:self.block], []).append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of every occurrence of a pattern, in order of start."""
        length, block, most, shift, n = self.length, self.block, self.most, self.shift, len(words)
        at = length
        while at <= n:
            key = tuple(words[at - block:at])
            move = shift.get(key, most)
            if move:
                at += move
                continue
            start = at - length
            for pattern, items in self.buckets[key].get(tuple(words[start:start + block]), ()):
                if pattern == tuple(words[start:at]):
                    yield start, items
            at += 1


class Patterns:
    """(pattern, item id) pairs; the tables are built once in each Python worker that reads the broadcast."""

    def __init__(self, pairs: list[tuple[bytes, object]]):
        self.pairs, self._tables = pairs, None

    def __getstate__(self):
        return {"pairs": self.pairs, "_tables": None}

    def tables(self) -> list[Tables]:
        if self._tables is None:
            lengths: dict[int, dict[tuple[bytes, ...], list]] = {}
            same: dict[bytes, bytes] = {}  # one object for each word
            for text, item in self.pairs:
                words = tuple(same.setdefault(w, w) for w in text.split())
                lengths.setdefault(len(words), {}).setdefault(words, []).append(item)
            self._tables = [Tables(p, n) for n, p in sorted(lengths.items())]
        return self._tables

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list]:
        """(number of words, merged [start, stop) spans of words in occurrences, item ids but null) of one text."""
        words, found, items = words_of(text), [], set()
        for table in self.tables():
            for start, of in table.search(words):
                if found and found[-1][0] <= start <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], start + table.length)
                else:
                    found.append([start, start + table.length])
                items.update(of)
        return len(words), merged(found), sorted(items - {None})


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def patterns_of(items: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(pattern binary, item): the distinct pairs of a window's words, joined by a space, and its item's id."""
    item = items.schema[id_col].dataType.simpleString()

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, i in zip(pdf["text"], pdf["item"].array):
                words = words_of(text)
                for at in range(max(len(words) - width + 1, min(len(words), 1))):
                    rows.append((b" ".join(words[at:at + width]), i))
            yield pd.DataFrame(rows, columns=["pattern", "item"])

    return (items.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("item")).distinct()
            .mapInPandas(windows, f"pattern binary, item {item}").distinct())


def _scanner(shared, kind: str):
    @F.pandas_udf(f"struct<n_words: long, spans: array<struct<start: int, stop: int>>, items: array<{kind}>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        patterns = shared.value
        for texts in batches:
            rows = [patterns.scan(t) for t in texts]
            yield pd.DataFrame({"n_words": [r[0] for r in rows],
                                "spans": [[{"start": a, "stop": b} for a, b in r[1]] for r in rows],
                                "items": [r[2] for r in rows]})

    return scan


def _in_blocks(docs: DataFrame, text_col: str, pairs: DataFrame, blocks: int, kind: str) -> DataFrame:
    """``docs`` with the column _found, from one pass for each block of patterns."""

    @F.pandas_udf("array<struct<start: int, stop: int>>")
    def union(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": b} for a, b in merged([(s["start"], s["stop"]) for s in some])] for some in lists])

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    context = docs.sparkSession.sparkContext
    key, text = text_key(text_col), F.col(text_col).cast("binary")
    found = []
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == b).collect()
        scan = _scanner(context.broadcast(Patterns([(bytes(r[0]), r[1]) for r in mine])), kind)
        found.append(docs.select(key.alias("_tk"), scan(text).alias("f")).where("size(f.spans) > 0")
                     .select("_tk", F.lit(b).alias("b"), "f.spans", "f.items").dropDuplicates(["_tk"]))
    both = found[0]
    for more in found[1:]:
        both = both.union(more)
    both = (both.groupBy("_tk").agg(F.collect_list("spans").alias("s"), F.collect_list("items").alias("i"))
            .select("_tk", union(F.flatten("s")).alias("s"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("i")))
    wide = docs.withColumn("_tk", key).join(both, "_tk", "left")
    none = F.array().cast("array<struct<start: int, stop: int>>")
    return wide.withColumn("_found", F.struct(
        count(text).alias("n_words"), F.coalesce("s", none).alias("spans"),
        F.coalesce("i", F.array().cast(f"array<{kind}>")).alias("items"))).drop("_tk", "s", "i")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", width: int = WIDTH, out: str = "bd_") -> DataFrame:
    """``docs`` (all columns) with n_words, spans and items, prefixed ``out``.

    spans: the maximal runs [start, stop) of words that lie in an occurrence of
    any window of an item, in order; items: ids of the items with such a
    window, ascending.  A null or wordless text has no words, spans or items;
    an item without words has no window; one with a null id marks words but is
    not listed; items equal in id are one item with the windows of all its
    rows; repeated documents are judged each for itself; an empty table gives
    an empty one, and without items nothing is found.  Texts are searched
    whole, whatever their length.  Other columns pass through, whatever their
    names; the added ones come last.
    """
    if width < 1:
        raise ValueError("a window holds a word at least")
    names = docs.columns
    docs, (text_col,) = numbered(docs, text_col)
    pairs = materialize(patterns_of(items, item_col, item_text_col, width))
    kind = pairs.schema["item"].dataType.simpleString()
    size = pairs.agg(F.coalesce(F.sum(F.lit(PAIR_BYTES) + 2 * F.octet_length("pattern")), F.lit(0))).first()[0]
    if size <= MOST_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast(Patterns([(bytes(r[0]), r[1]) for r in pairs.collect()]))
        wide = docs.withColumn("_found", _scanner(shared, kind)(F.col(text_col).cast("binary")))
    else:
        wide = _in_blocks(docs, text_col, pairs, -(-size // MOST_BYTES), kind)
    return (wide.select(*docs.columns, "_found.n_words", "_found.spans", "_found.items")
            .toDF(*names, *[out + c for c in ("n_words", "spans", "items")]))
