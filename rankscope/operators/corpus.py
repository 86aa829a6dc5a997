"""Corpus loading.

A raw QA frame has department, title, ask, answer and one or more load-order
columns.  Each canonical department plays the role of one source file: rows
are deduplicated and numbered inside it, in load order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankscope.functions.text import answer_key, clean_text, format_id, make_context
from rankscope.operators.ranking import range_number
from rankscope.session import materialize
from rankscope.sources.csv import path_exists, read_csv_auto

RAW_COLUMNS = ("department", "title", "ask", "answer")
CORPUS_COLUMNS = ["canonical_department", "raw_id", "row_no", "department", "title", "ask", "answer",
                  "context", "answer_key"]


def load_qa(raw: DataFrame, order: Sequence[str], canonical: str | None = None,
            max_chars: int = 900, features: Mapping[str, Column] | None = None) -> DataFrame:
    """S3: clean, drop empty ask/answer (F1), keep the first (ask, answer) per
    source (D1), number rows per source (P8), build context and answer_key.

    ``canonical`` names the source for every row; by default the raw
    department column is the source tag.  Dedupe is an aggregate with a
    min(load order) struct, so a hugely duplicated pair never sits in one task.

    With ``features``, columns of title, ask, answer, context and answer_key,
    each row has these in the place of its texts, which never leave the task
    that reads them.
    """
    missing = [c for c in RAW_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"raw QA frame missing columns: {missing}")
    tag = F.lit(canonical) if canonical is not None else F.col("department").cast("string")
    c = raw.select(tag.alias("canonical_department"), *[clean_text(x).alias(x) for x in RAW_COLUMNS],
                   *[F.col(o) for o in order])
    c = c.where((F.col("ask") != "") & (F.col("answer") != ""))
    digest = lambda x: F.coalesce(F.md5(x), F.lit("-"))
    c = c.withColumn("_k", F.md5(F.concat(*[digest(x) for x in ("canonical_department", "ask", "answer")])))
    texts = ("title", "department", "ask", "answer", "canonical_department")
    made = {"context": make_context("title", "ask", "answer", max_chars), "answer_key": answer_key("answer")}
    if features is not None:  # the rows of a key differ in order, title and department, and so in those alone
        c = c.withColumns(made).withColumns(features)
        texts = ("title", "department", *features, "canonical_department")
    first = materialize(c.groupBy("_k").agg(F.min(F.struct(*[F.col(x) for x in (*order, *texts)])).alias("_f"))
                        .select("_k", *[F.col(f"_f.{x}").alias(f"_o{i}") for i, x in enumerate(order)],
                                *[F.col(f"_f.{x}").alias(x) for x in texts]))
    # a source may hold a third of all rows: only keys and load orders are sorted by it, and those by range
    orders = [f"_o{i}" for i in range(len(order))]
    numbers = range_number(first.select("_k", "canonical_department", *orders), ["canonical_department"],
                           [*[F.col(o).asc() for o in orders], F.col("_k").asc()], "row_no")
    numbered = first.join(numbers.select("_k", "row_no"), "_k")
    whole = ["department", "title", "ask", "answer", *[c.alias(name) for name, c in made.items()]]
    return numbered.select(
        "canonical_department",
        format_id(F.concat(F.col("canonical_department"), F.lit("_")), F.col("row_no") - 1, 6).alias("raw_id"),
        (F.col("row_no") - 1).alias("row_no"), *(whole if features is None else features))


def load_sources(frames: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """One raw frame per canonical department, loaded and unioned."""
    if not frames:
        raise ValueError("no sources given")
    out = None
    for dept, raw in frames.items():
        part = load_qa(raw, order, canonical=dept)
        out = part if out is None else out.unionByName(part)
    return out


def load_source_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Canonical department -> CSV path; every missing path is named before anything is read."""
    absent = [f"{d}: {p}" for d, p in paths.items() if not path_exists(spark, p)]
    if absent:
        raise FileNotFoundError(f"no source files at {', '.join(absent)}")
    frames = {d: read_csv_auto(spark, p).withColumn("_line", F.monotonically_increasing_id())
              for d, p in paths.items()}
    return load_sources(frames, ["_line"])
