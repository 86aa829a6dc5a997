"""Substring dedup over sliding sentence spans.

A run is at least ``min_sentences`` sentences with at least ``min_words`` words
together.  For every sentence of every text the shortest run that starts with
it and the shortest one that ends with it are hashed: together they cover every
sentence of any run that repeats.  They are joined over the corpus, and each
sentence that a run covers which is not the first of its equals (by document
id, then place) is removed.  A sentence of more than ``LONG`` words is cut into
pieces at borders that its own words choose, and each counts as a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankscope.llm.common import numbered

MIN_SENTENCES = 2
MIN_WORDS = 20
#: Words above which a sentence is cut into pieces; words of a piece at most.  A passage of 2 * PIECE + MIN_WORDS
#: words within such a sentence holds a run of pieces wherever it lies.
LONG, PIECE = 50, 15
_WORD = re.compile(r"\S+")
_END = re.compile(r"[\n.!?…。！？](?:(?<=\n)|\s)")


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of ``text``, long ones in pieces; together they are the whole text.

    A sentence ends after . ! ? or an ellipsis before white space, or after a
    line break.  White space between sentences belongs to the later one.
    """
    return [(a, b) for a, b, _ in _units(text)]


def _units(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of ``pieces``."""
    cuts = [0, *(m.start() + 1 for m in _END.finditer(text))]
    if cuts[-1] != len(text):
        cuts.append(len(text))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        words = text[a:b].split()
        if len(words) > LONG:
            out += _cut_long(text, a, b, words)
        else:
            out.append((a, b, words))
    return out


def _cut_long(text: str, start: int, end: int, words: list[str]) -> list[tuple[int, int, list[str]]]:
    """A sentence above LONG words, cut before the last least word hash of every PIECE words.

    The borders within two equal passages are equal from the first PIECE words
    on up to the last, whatever stands around them.
    """
    h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(h[::-1], PIECE).argmin(axis=1)
    at = [k for k in np.unique(len(h) - 1 - (least + np.arange(len(least)))).tolist() if k]
    ends = [m.end() for m in _WORD.finditer(text, start, end)]
    cuts = [start, *(ends[k - 1] for k in at), end]
    at = [0, *at, len(words)]
    return [(a, b, words[i:k]) for a, b, i, k in zip(cuts, cuts[1:], at, at[1:])]


def _n_pieces(text: str) -> int:
    """How many of ``pieces`` hold a word."""
    cuts = [0, *(m.start() + 1 for m in _END.finditer(text))]
    if cuts[-1] != len(text):
        cuts.append(len(text))
    n = 0
    for a, b in zip(cuts, cuts[1:]):
        if b - a <= 2 * LONG:
            n += not text[a:b].isspace()
        else:
            words = text[a:b].split()
            n += len(_cut_long(text, a, b, words)) if len(words) > LONG else bool(words)
    return n


def shortest_runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray, min_sentences: int,
                  min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the shortest run that starts with each sentence, and of that which ends with it, in order.

    ``words`` has the sentences' words, ``begin`` and ``end`` the borders of each one's text among the sentences.
    Of a run R from a to b every sentence i lies in one of these within R: in
    the shortest that starts with a, or else that one ends before i, so that
    the shortest that ends with i starts at a or later.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    n = np.arange(len(words))
    last = np.maximum(n + min_sentences, np.searchsorted(total, total[:-1] + min_words, "left"))
    first = np.minimum(n + 1 - min_sentences, np.searchsorted(total, total[1:] - min_words, "right") - 1)
    starts, ends = last <= end, first >= begin
    keys = np.unique(np.r_[n[starts] * (len(n) + 1) + last[starts], first[ends] * (len(n) + 1) + n[ends] + 1])
    return keys // (len(n) + 1), keys % (len(n) + 1)


def _runs(texts, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(first sentences of the texts, texts, first, number, digest of the runs) over all sentences with a word."""
    digests, words, sizes = [], [], []
    for text in texts:
        before = len(words)
        for _, _, some in _units(text) if text else ():
            if some:
                digests.append(xxhash.xxh3_128_digest(" ".join(some).encode("utf-8", "surrogatepass")))
                words.append(len(some))
        sizes.append(len(words) - before)
    sizes = np.array(sizes, dtype=np.int64)
    border = np.r_[0, np.cumsum(sizes)]
    first, stop = shortest_runs(np.array(words, dtype=np.int64), np.repeat(border[:-1], sizes),
                                np.repeat(border[1:], sizes), min_sentences, min_words)
    whole = memoryview(b"".join(digests))
    found = [xxhash.xxh3_128_digest(whole[16 * i:16 * k]) for i, k in zip(first.tolist(), stop.tolist())]
    return border, np.repeat(np.arange(len(sizes)), sizes)[first], first, stop - first, found


def runs(text: str, min_sentences: int = MIN_SENTENCES,
         min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int]], list[tuple[int, int, bytes]]]:
    """The sentences with a word, and runs (first, number of sentences, 16-byte digest).  White space is normalised."""
    _, _, first, n, digests = _runs([text], min_sentences, min_words)
    return [(a, b) for a, b, words in _units(text) if words], list(zip(first.tolist(), n.tolist(), digests))


def _emit(min_sentences: int, min_words: int):
    """mapInPandas body: a row for each run, with its digest (h0, h1).

    Of equal runs in a batch only the first by place can be the first of all, so that no digest has more rows than
    there are batches; the others are ``later`` ones, spread over the cluster by a hash of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            border, row, first, n, digests = _runs(pdf["text"], min_sentences, min_words)
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            ids, tk, at = pd.factorize(pdf["id"], sort=True)[0], pdf["tk"].to_numpy(), (first - border[row]).astype(np.int32)
            ids = np.where(ids < 0, len(pdf), ids)  # without an id: last
            order = np.lexsort((at, tk[row], ids[row], h[:, 1], h[:, 0]))
            row, at, n, h = row[order], at[order], n[order], h[order]
            fresh = np.r_[True, (h[1:] != h[:-1]).any(axis=1)] if len(h) else np.zeros(0, bool)
            lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(h) else row
            later = (ids[row] != ids[row[lead]]) | (tk[row] != tk[row[lead]]) | (at != at[lead])
            kept = fresh | later  # a repeated row of the first place says nothing more
            spread = tk[row] + at * np.int64(0x9E3779B97F4A7C1)
            yield pd.DataFrame({"h0": np.where(later, spread, h[:, 0])[kept], "h1": np.where(later, 0, h[:, 1])[kept],
                                "id": pdf["id"].array.take(row[kept]), "tk": tk[row][kept], "at": at[kept],
                                "n": n[kept].astype(np.int32), "later": later[kept]})

    return run


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, tk, at, n): runs of ``docs`` that are not the first of their equals; tk is the text's hash.

    Rows equal in id and text have equal places, so none of them is later than another.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tk"),
                       F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInPandas(_emit(min_sentences, min_words),
                             f"h0 long, h1 long, id {id_type}, tk long, at int, n int, later boolean")
    equal = Window.partitionBy("h0", "h1", "later").orderBy(F.col("id").asc_nulls_last(), "tk", "at")
    return (found.withColumn("place", F.rank().over(equal)).where("later or place > 1").select("id", "tk", "at", "n"))


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
                          out: str = "sd_") -> DataFrame:
    """``docs`` (all columns) without the sentences of non-first repeated runs.

    Adds n_sentences, n_removed (sentences; pieces of long ones count) and spans (array of removed
    (start, end) in code points of the input text), prefixed ``out``.  A null
    text stays null and an empty one empty, with no sentence; of one text that
    repeats a run the first place stays; rows equal in id and text are one
    document and all get its result; a null id counts as the last one; an
    empty table gives an empty one.  Other columns pass through, whatever
    their names; the added ones come last.
    """
    names = docs.columns
    docs, (id_col, text_col) = numbered(docs, id_col, text_col)
    gone = repeated_runs(docs, id_col, text_col, min_sentences, min_words)
    gone = (gone.groupBy("id", "tk").agg(F.collect_set(F.struct("at", "n")).alias("_runs"))
            .select(F.col("id").alias("_id"), F.col("tk").alias("_tk2"), "_runs"))
    wide = docs.withColumn("_tk", F.xxhash64(F.col(text_col)))
    wide = wide.join(gone, wide[id_col].eqNullSafe(gone["_id"]) & (wide["_tk"] == gone["_tk2"]), "left")

    @F.pandas_udf("struct<text string, n_sentences long, n_removed long, spans array<struct<start int, end int>>>")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for text, covered in zip(texts, lists):
            if covered is None:
                out.append((text, _n_pieces(text or ""), 0, []))
                continue
            spans = [(a, b) for a, b, words in _units(text) if words]
            drop = np.zeros(len(spans) + 1, dtype=np.int64)
            for r in covered:
                drop[r["at"]] += 1
                drop[r["at"] + r["n"]] -= 1
            drop = np.flatnonzero(np.cumsum(drop)[:-1] > 0)
            cuts: list[list[int]] = []
            for k in drop.tolist():
                if cuts and k == cuts[-1][2] + 1:
                    cuts[-1][1:] = [spans[k][1], k]
                else:
                    cuts.append([spans[k][0], spans[k][1], k])
            edges = [0, *(x for c in cuts for x in c[:2]), len(text)]
            kept = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((kept, len(spans), len(drop), [{"start": a, "end": b} for a, b, _ in cuts]))
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed", "spans"])

    wide = wide.withColumn("_cut", cut(F.col(text_col).cast("string"), F.col("_runs")))
    cols = [F.col("_cut.text").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    added = ["n_sentences", "n_removed", "spans"]
    return wide.select(*cols, *[F.col(f"_cut.{c}") for c in added]).toDF(*names, *[out + c for c in added])
