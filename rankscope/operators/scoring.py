"""Pair scoring: stored-similarity baselines (M1, M2), engineered features
(M3), and a plug-in batch scorer for opaque models (M7-M11).

Expression scorers stay JVM-side.  Only ``score_pairs`` runs Python, once per
Arrow batch (mapInPandas), with the model built once per task.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankscope.functions.numeric import capped_length, length_ratio, match_indicator, to_double_or
from rankscope.functions.text import keyword_overlap
from rankscope.operators.ranking import rank_scores

# ---------------------------------------------------------------------------
# Feature names in their order.
# ---------------------------------------------------------------------------
FEATURE_COLUMNS = ["embedding_score", "keyword_overlap", "department_match", "question_length",
                   "context_length", "length_ratio"]


def baseline_scores(cand: DataFrame, method: str = "embedding_baseline") -> DataFrame:
    """M1: score = stored embedding_score, latency 0, ranked."""
    s = cand.select("qid", "context_id", F.col("embedding_score").cast("double").alias("score"),
                    F.lit(0.0).alias("latency_ms"))
    return rank_scores(s, method)


def bonus_scores(cand: DataFrame, bonus: float = 0.05, method: str = "embedding_department_bonus") -> DataFrame:
    """M2: embedding_score + bonus when question and candidate department match."""
    if "question_department" not in cand.columns:
        raise ValueError("candidates missing column for department bonus: question_department")
    s = cand.select("qid", "context_id",
                    (to_double_or("embedding_score") +
                     match_indicator("question_department", "department") * F.lit(float(bonus))).alias("score"),
                    F.lit(0.0).alias("latency_ms"))
    return rank_scores(s, method)


def build_features(cand: DataFrame, keep: Sequence[str] = ("qid", "context_id", "label")) -> DataFrame:
    """M3: the six pair features in one projection (missing text has length 0)."""
    return cand.select(
        *keep,
        to_double_or("embedding_score").alias("embedding_score"),
        keyword_overlap("question", "candidate_context").alias("keyword_overlap"),
        match_indicator("question_department", "department").alias("department_match"),
        capped_length("question", 500).alias("question_length"),
        capped_length("candidate_context", 1500).alias("context_length"),
        length_ratio("question", "candidate_context").alias("length_ratio"))


# --------------------------------------------------------------------------- plug-in scorers

def row_scores(raw, n: int, apply_sigmoid: bool = False) -> np.ndarray:
    """M9: last logit when a row has several, scalar -> list, optional sigmoid."""
    a = np.asarray(raw, dtype=np.float64)
    if a.ndim == 0:
        a = np.full(n, float(a))
    elif a.ndim == 2:
        a = a[:, -1]
    a = a.reshape(-1)
    if len(a) != n:
        raise ValueError(f"scorer returned {len(a)} scores for {n} pairs")
    return 1.0 / (1.0 + np.exp(-a)) if apply_sigmoid else a


def row_subset(rows: DataFrame, split: DataFrame | None, subset: str) -> DataFrame:
    """All rows, or those whose qid ``split`` (qid, split) puts into ``subset``, train or test."""
    if subset == "all":
        return rows
    if subset not in ("train", "test") or split is None:
        raise ValueError("a subset is all, or train or test of a given split")
    return rows.join(split.where(F.col("split") == subset).select("qid"), "qid", "left_semi")


def score_pairs(pairs: DataFrame, scorer_factory: Callable[[], Callable[[list, list], object]],
                method: str, batch_size: int = 64, max_length: int | None = None, apply_sigmoid: bool = False,
                question: str = "question", context: str = "candidate_context", split: DataFrame | None = None,
                subset: str = "all") -> DataFrame:
    """M7 + M8 + M10 + M11, then W1.

    ``scorer_factory()`` returns ``score(questions, contexts) -> array``; it is
    called once per task.  Texts are passed whole unless ``max_length`` gives
    the characters that the model can take.  A task scores its pairs in order
    of length, ``batch_size`` at a time whatever the size of Arrow batches, so
    that the pairs of a batch are about equally long and a model pads little;
    the latency column is the batch's elapsed milliseconds per pair.  Keys
    travel with the rows, so no order has to be restored.  Only the rows of
    ``subset`` are scored.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")

    def text(column: str) -> Column:
        whole = F.coalesce(F.col(column).cast("string"), F.lit(""))
        return whole if max_length is None else F.substring(whole, 1, max_length)

    base = (row_subset(pairs, split, subset).select("qid", "context_id", text(question).alias("_q"), text(context).alias("_c"))
            .sortWithinPartitions((F.length("_q") + F.length("_c")).desc(), "qid", "context_id"))
    qtype, ctype = dict(base.dtypes)["qid"], dict(base.dtypes)["context_id"]

    def run(batches):
        score = scorer_factory()

        def scored(pdf: pd.DataFrame) -> pd.DataFrame:
            qs, cs = pdf["_q"].tolist(), pdf["_c"].tolist()
            out, ms = np.empty(len(pdf), dtype=np.float64), np.empty(len(pdf), dtype=np.float64)
            for i in range(0, len(pdf), batch_size):
                t0 = time.perf_counter()
                some = slice(i, i + batch_size)
                n = len(qs[some])
                out[some] = row_scores(score(qs[some], cs[some]), n, apply_sigmoid)
                ms[some] = (time.perf_counter() - t0) * 1000.0 / n
            return pd.DataFrame({"qid": pdf["qid"], "context_id": pdf["context_id"], "score": out, "latency_ms": ms})

        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            full = len(held) // batch_size * batch_size
            if full:
                yield scored(held.iloc[:full])
                held = held.iloc[full:]
        if held is not None and len(held):
            yield scored(held)

    scored = base.mapInPandas(run, f"qid {qtype}, context_id {ctype}, score double, latency_ms double")
    return rank_scores(scored, method)


def char_histogram_scorer(buckets: int = 64) -> Callable[[list, list], np.ndarray]:
    """A deterministic numpy scorer: cosine of hashed character histograms."""

    def hist(texts: list) -> np.ndarray:
        m = np.zeros((len(texts), buckets), dtype=np.float64)
        for i, t in enumerate(texts):
            codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) if t else np.zeros(0, np.uint32)
            if len(codes):
                np.add.at(m[i], (codes.astype(np.int64) * 2654435761 % buckets), 1.0)
        return m

    def score(qs: list, cs: list) -> np.ndarray:
        a, b = hist(qs), hist(cs)
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        den = na * nb
        return np.where(den > 0, (a * b).sum(axis=1) / np.where(den > 0, den, 1.0), 0.0)

    return score
