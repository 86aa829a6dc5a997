"""Exact substring dedup by sorted suffixes over a difference cover.

What is needed of a suffix array is its order to a depth of ``length`` bytes,
and which neighbours share a prefix of that depth.  As in the difference-cover
algorithm a sample of positions is sorted first and the remaining suffixes are
merged through it:

1. Sample.  Position i belongs to the sample p(i): the smallest word hash among
   the WINDOW words from i on.  Equal strings of ``length`` bytes choose samples
   at equal distances, which is what a difference cover is for; a cover by
   residues (1 and 2 modulo 3) would sort two thirds of all positions, this one
   about one in eighty.
2. Sort and name.  Sampled suffixes are sorted over the cluster by the name of
   their common core (the bytes that every string of the sample holds), then by
   the name of their whole context.  A core that has no equal neighbour ends all
   its strings' matches; a context that has one settles them all.
3. Recurse.  Of the other samples, those with equal cores are named byte by byte
   outwards, each name standing for (name of one byte less, byte).
4. Merge.  A remaining suffix is (name of the bytes before its sample, name of
   the sample's bytes to the depth that is left); equal neighbours in this order
   are the strings that occur again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankscope.llm.common import materialize, numbered
from rankscope.session import num_partitions

LENGTH = 200
WINDOW = 160
_WORD = 8
_CHUNK = 1 << 22
_AT = np.uint64((1 << 24) - 1)
#: Documents, and about as many rows of their samples, that the borders of the sort are chosen by.
_SEEN_DOCS, _SEEN_ROWS = 4_000, 50_000
#: Unsettled rows of one core above which they are grouped by more bytes, for _CUTS ranges of places of a string.
_HOT_ROWS, _CUTS = 4_000, 8


_SAMPLE = "at int, h long, u long, k binary, p long, near int, far int"


def samples(data: bytes, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, first, last): sampled positions and the first and last start of the strings that belong to each."""
    n = len(data) - length + 1
    parts = []
    for a in range(0, max(n, 0), _CHUNK):
        b = min(a + _CHUNK, n)
        x = np.frombuffer(data, dtype=np.uint8, offset=a, count=b - a + window + _WORD - 2).astype(np.uint64)
        m = len(x) - _WORD + 1
        h = x[:m].copy()
        for k in range(1, _WORD):
            h |= x[k:m + k] << np.uint64(8 * k)
        h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        low = (h & ~_AT) | np.arange(m, dtype=np.uint64)  # of equal hashes the leftmost
        step = 1
        while step * 2 <= window:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < window:
            low = np.minimum(low[:step - window], low[window - step:])
        parts.append((low & _AT).astype(np.int64) + a)
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    at = np.concatenate(parts)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:] - 1, len(at) - 1]


def _twice(keys: Iterator[bytes], seen: dict[bytes, int]) -> list[bool]:
    """Whether each key is the first or second of its equals; further copies of a text tell nothing more."""
    out = []
    for k in keys:
        seen[k] = n = seen.get(k, 0) + 1
        out.append(n <= 2)
    return out


def _emit_samples(length: int, window: int, borders: list[tuple[int, int, bytes]]):
    """mapInPandas body: the samples of each text with the number of their range, h and u being hashes of core and context."""
    core = length - window + 1
    by_h = np.array([b[0] for b in borders], dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        for pdf in batches:
            out = []
            for k, text, first in zip(pdf["k"], pdf["text"], _twice(pdf["k"], seen)):
                data = (text or "").encode("utf-8", "surrogatepass") if first else b""
                p, first, last = samples(data, length, window)
                if not len(p):
                    continue
                h, u = [], []
                for x in p.tolist():
                    a = max(0, x - window + 1)
                    h.append(xxhash.xxh64_intdigest(data[x:x + core]))
                    u.append(xxhash.xxh64_intdigest(data[a:x + length], x - a))
                h, u = np.array(h, np.uint64).view(np.int64), np.array(u, np.uint64).view(np.int64)
                at, after = np.searchsorted(by_h, h, "left"), np.searchsorted(by_h, h, "right")
                for i in np.flatnonzero(at < after).tolist():  # a core that holds borders
                    at[i] = bisect_left(borders, (int(h[i]), int(u[i]), k))
                out.append(pd.DataFrame({"at": at, "h": h, "u": u, "k": k, "p": p, "near": (p - last).astype(np.int32),
                                         "far": (p - first).astype(np.int32)}))
            if out:
                yield pd.concat(out)

    return run


def _borders(texts: DataFrame, length: int, window: int, parts: int) -> list[tuple[int, int, bytes]]:
    """Borders of about equal ranges of the samples' order by (h, u, k), from a bounded sample of the texts.

    They only tell where rows go, not what is found.
    """
    docs = texts.count()
    some = texts.sample(min(1.0, _SEEN_DOCS / docs), 7) if docs else texts
    rows = materialize(some.select("k", "text").mapInPandas(_emit_samples(length, window, []), _SAMPLE)
                       .select("h", "u", "k", "p"))
    every = rows.count() // _SEEN_ROWS + 1
    picked = rows.where(F.pmod(F.xxhash64("u", "k", "p"), F.lit(every)) == 0).collect()
    # a copied text once, as few of its copies are told anyway, but each place of a text
    seen = sorted((h, u, k) for h, u, k, _ in {(r.h, r.u, bytes(r.k), r.p) for r in picked})
    return sorted({seen[len(seen) * n // parts] for n in range(1, parts)}) if seen else []


def _adjacent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares neighbours of the sorted samples.

    Gives settled rows (state 0), rows that need more bytes (1), and witnesses (2), one for each settled context
    with other contexts of its core.  The first and last core of a partition may go on in the next one, so their
    rows always need more bytes or have a witness; that only costs a look.
    """

    def judge(pdf: pd.DataFrame, edge: bool) -> pd.DataFrame:
        h, u = pdf["h"].to_numpy(), pdf["u"].to_numpy()
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_u = new_h | np.r_[True, u[1:] != u[:-1]]
        core, context = np.cumsum(new_h) - 1, np.cumsum(new_u) - 1
        many = np.bincount(context)[context] > 1
        several = np.bincount(core[new_u])[core] > 1
        open_core = (core == core[-1]) | ((core == 0) if edge else False)
        several |= open_core
        rows = pdf[["k", "p", "near", "far", "h"]]
        settled = rows[many].assign(state=0).drop_duplicates(["k", "p"])
        more = rows[~many & several].assign(state=1)
        seen = rows[many & several & new_u].assign(state=2)
        return pd.concat([settled, more, seen])

    held, edge = None, True
    for pdf in batches:
        if not len(pdf):
            continue
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        tail = held["h"] == held["h"].iloc[-1]
        if not tail.all():
            done = held[~tail]
            yield judge(done, edge)
            edge = False
            held = held[tail].reset_index(drop=True)
    if held is not None:
        yield judge(held, edge)


def _names(before: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, int]:
    _, out = np.unique(before * 257 + column, return_inverse=True)
    return out, int(out.max()) + 1


def _merge(length: int, window: int):
    """Groups of equal cores, or parts of them -> (k, start, stop): what the strings of each sample that occur again cover."""
    side = window - 1

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        left, right = (np.array([np.frombuffer(x, np.uint8) for x in pdf[c]], dtype=np.int64).reshape(n, -1)
                       for c in ("left", "right"))
        left_size, right_size = pdf["left_size"].to_numpy(), pdf["right_size"].to_numpy()
        group = pd.factorize(pdf["g"])[0].astype(np.int64)
        near, far = pdf["near"].to_numpy(), pdf["far"].to_numpy()
        to_right, kinds = [group], 0
        for e in range(side):
            if kinds < n:
                name, kinds = _names(to_right[-1], np.where(e < right_size, right[:, e] + 1, 0))
            to_right.append(name)
        low, high = np.full(n, -1), np.full(n, -1)
        name, kinds = group, 0
        for a in range(window):
            if a and kinds < n:
                name, kinds = _names(name, np.where(a <= left_size, left[:, a - 1] + 1, 0))
            here = np.flatnonzero((near <= a) & (a <= far))
            if len(here) > 1:
                key = name[here] * (n + 1) + to_right[side - a][here]
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                twice = here[order[np.r_[same, False] | np.r_[False, same]]]
                low[twice] = np.where(low[twice] < 0, a, low[twice])
                high[twice] = a
        found = (high >= 0) & (pdf["state"].to_numpy() == 1)
        p = pdf["p"].to_numpy()
        return pd.DataFrame({"k": pdf["k"].to_numpy()[found], "start": (p - high)[found],
                             "stop": (p - low + length)[found]})

    return work


def _contexts(length: int, window: int):
    """mapInArrow body: wanted samples with the bytes around their core, in groups g of equal cores.

    A hot core has a group for each range of distances from a string's start to the sample, and for the bytes that all
    strings of these distances hold.
    """
    core, side, step = length - window + 1, window - 1, -(-window // _CUTS)
    kinds = pa.schema([("g", pa.int64()), ("k", pa.binary()), ("p", pa.int64()), ("near", pa.int32()),
                       ("far", pa.int32()), ("state", pa.int32()), ("left_size", pa.int32()),
                       ("right_size", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])

    def groups(w: dict, left: bytes, right: bytes) -> Iterator[tuple[int, int, int]]:
        near, far = w["near"], w["far"]
        if not w["hot"]:
            yield w["h"], near, far
            return
        for a in range(near // step * step, far + 1, step):
            same = xxhash.xxh64(left[:a], w["h"] & 0xFFFFFFFFFFFFFFFF)
            same.update(right[:max(0, side - (a + step - 1))])
            same.update(a.to_bytes(4, "big"))
            yield int(np.uint64(same.intdigest()).view(np.int64)), max(near, a), min(far, a + step - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            some = batch.filter(pc.is_valid(batch.column("wanted")))
            keys, out = some.column("k").to_pylist(), []
            for k, text, wanted, first in zip(keys, some.column("text"), some.column("wanted"), _twice(keys, seen)):
                if not first:
                    continue
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    p = w["p"]
                    left, right = data[max(0, p - side):p][::-1], data[p + core:p + length]
                    for g, near, far in groups(w, left, right):
                        out.append((g, k, p, near, far, w["state"], len(left), len(right),
                                    left.ljust(side, b"\0"), right.ljust(side, b"\0")))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)] if out else
                                             [pa.array([], f.type) for f in kinds], schema=kinds)

    return run


def _whole_groups(key: str, work, rows: int = 20_000):
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


def repeated_spans(texts: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(k, spans) of the texts with repeats; ``texts`` has k (digest of the text) and text, one row per document.

    spans: (start, stop) in bytes covered by strings of ``length`` bytes that start at another place too, merged
    where they overlap or touch, in order.  Other columns of ``texts`` go through the exchange by k, so that a left
    join of the same frame with the result finds the texts dealt out already.
    """
    if not _WORD <= length - window + 1 or window < 2:
        raise ValueError("the window must leave a core of a word")
    parts = num_partitions(texts.sparkSession)
    span = "array<struct<start: long, stop: long>>"

    @F.pandas_udf(span)
    def union(lists: pd.Series) -> pd.Series:
        out = []
        for spans in lists:
            joined: list[list[int]] = []
            for a, b in sorted((s["start"], s["stop"]) for s in spans):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            out.append([{"start": a, "stop": b} for a, b in joined])
        return pd.Series(out)

    borders = _borders(texts, length, window, parts)
    rows = texts.select("k", "text").mapInPandas(_emit_samples(length, window, borders), _SAMPLE)
    judged = (rows.repartitionById(len(borders) + 1, "at").drop("at").sortWithinPartitions("h", "u", "k", "p")
              .mapInPandas(_adjacent, "k binary, p long, near int, far int, h long, state int"))
    settled = F.when(F.col("state") == 0, F.struct((F.col("p") - F.col("far")).alias("start"),
                                                   (F.col("p") - F.col("near") + length).alias("stop")))
    more = F.when(F.col("state") > 0, F.struct("h", "p", "near", "far", "state"))
    known = materialize(judged.groupBy("k").agg(F.collect_list(settled).alias("spans"), F.collect_set(more).alias("more"))
                        .select("k", union("spans").alias("spans"), "more"))
    open_ = known.select("k", F.inline("more"))
    hot = open_.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _HOT_ROWS).select("h", F.lit(True).alias("hot"))
    wanted = (open_.join(hot, "h", "left").groupBy("k")
              .agg(F.collect_list(F.struct("h", "p", "near", "far", "state", "hot")).alias("wanted")))
    contexts = (texts.join(wanted, "k", "left")
                .mapInArrow(_contexts(length, window), "g long, k binary, p long, near int, far int, state int, "
                            "left_size int, right_size int, left binary, right binary"))
    merged = (contexts.repartition(parts, "g").sortWithinPartitions("g")
              .mapInPandas(_whole_groups("g", _merge(length, window)), "k binary, start long, stop long"))
    both = (known.select("k", F.inline("spans")).union(merged).groupBy("k")
            .agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    return both.select("k", union("spans").alias("spans"))


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, window: int = WINDOW,
                   out: str = "sa_") -> DataFrame:
    """``docs`` without the text, plus n_bytes, n_removed, n_spans, spans and kept, prefixed ``out``.

    kept: the bytes of the UTF-8 text that no string of ``length`` bytes covers
    which also starts anywhere else, in the same document or another; strings
    are judged on the input.  A null text is an empty one, with nothing to
    remove; a text shorter than ``length`` stays whole; repeated rows are
    documents of their own, so that long enough ones go wholly; an empty table
    gives an empty one; other columns pass through, whatever their names, and
    the added ones come last.
    """
    carried = [c for c in docs.columns if c != text_col]
    docs, (text_col,) = numbered(docs, text_col)
    key = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    wide = docs.select(*[F.col(c).cast("string").alias("text") if c == text_col else F.col(c) for c in docs.columns],
                       key.alias("k"))
    wide = wide.join(repeated_spans(wide, length, window), "k", "left")

    @F.pandas_udf("struct<n_bytes long, n_removed long, n_spans long, kept binary>")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        rows = []
        for text, spans in zip(texts, lists):
            data = (text or "").encode("utf-8", "surrogatepass")
            edges = [0, *(x for s in (spans if spans is not None else []) for x in (s["start"], s["stop"])), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((len(data), len(data) - len(kept), len(edges) // 2 - 1, kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    rest = [c for c in docs.columns if c != text_col]
    wide = wide.withColumn("_cut", cut("text", "spans"))
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    return (wide.select(*rest, "spans", *[F.col(f"_cut.{c}") for c in added])
            .toDF(*carried, out + "spans", *[out + c for c in added]))
