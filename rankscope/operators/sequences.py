"""Sequence-dataset preparation for small cross-encoders.

The vocabulary is a small table (one row per distinct character, so bounded by
the code points there are).  Encoding looks ids up in an array indexed by code
point, a constant of the plan: each pair is encoded where it lies, without a
join, an explode or a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankscope.functions.text import clean_text

# ---------------------------------------------------------------------------
# Special tokens and their ids.
# ---------------------------------------------------------------------------
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
# ---------------------------------------------------------------------------


def char_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ch, count) over the cleaned text of every listed column of every row."""
    out = None
    for c in columns:
        part = df.select(F.explode(F.split(clean_text(c), "")).alias("ch")).where(F.col("ch") != "")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("ch").agg(F.count(F.lit(1)).alias("count"))


def build_vocab(df: DataFrame, columns: Sequence[str] = ("question", "candidate_context")) -> DataFrame:
    """T10 + K5: specials 0-3, then characters by count desc, char asc.

    The count table has one row per distinct character (bounded by the
    alphabet), so a single ordered window over it is cheap.
    """
    counts = char_counts(df, columns)
    ranked = counts.withColumn("id", (F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("ch").asc()))
                                      + len(SPECIAL_TOKENS) - 1).cast("int"))
    specials = df.sparkSession.createDataFrame(
        [(t, None, i) for i, t in enumerate(SPECIAL_TOKENS)], "ch string, count long, id int")
    return specials.unionByName(ranked)


def pair_lengths(q_len: Column, c_len: Column, max_content: int) -> tuple[Column, Column]:
    """T11 in closed form: pop from the longer side (context on ties) until
    q + c <= max_content."""
    m = F.lit(max_content)
    q2 = F.least(q_len, F.greatest(F.ceil(m / 2).cast("int"), m - c_len))
    c2 = F.least(c_len, F.greatest(F.floor(m / 2).cast("int"), m - q_len))
    return q2, c2


def ids_by_code_point(vocab: DataFrame) -> Column:
    """Constant array: the id of the character with each code point, UNK_ID for those that the vocabulary lacks."""
    rows = vocab.where(~F.col("ch").isin(*SPECIAL_TOKENS)).select("ch", "id").collect()
    odd = [r.ch for r in rows if len(r.ch) != 1]
    if odd:
        raise ValueError(f"vocabulary entries that are no single character: {odd[:3]}")
    ids = [str(UNK_ID)] * (max((ord(r.ch) for r in rows), default=0) + 1)
    for r in rows:
        ids[ord(r.ch)] = str(r.id)
    return F.split(F.lit(",".join(ids)), ",").cast("array<int>")  # folded once to a literal of the plan


def encode_pairs(df: DataFrame, vocab: DataFrame, max_length: int = 256, keys: Sequence[str] = ("qid", "context_id"),
                 question: str = "question", context: str = "candidate_context",
                 keep: Sequence[str] = ("label",)) -> DataFrame:
    """[CLS] q [SEP] c [SEP], unknown -> 1, segment ids 0/1, mask, pad to max_length.  One row for each row."""
    if max_length < 3:
        raise ValueError("max_length must be at least 3")
    table = ids_by_code_point(vocab)
    letters = lambda x: F.filter(F.split(clean_text(x), ""), lambda c: c != "")
    encoded = lambda cs: F.transform(cs, lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(UNK_ID)))
    base = df.select(*keys, *[k for k in keep if k in df.columns], letters(question).alias("_qc"),
                     letters(context).alias("_cc"))
    qn, cn = pair_lengths(F.size("_qc"), F.size("_cc"), max_length - 3)
    base = base.withColumns({"_qi": encoded(F.slice("_qc", F.lit(1), qn)), "_ci": encoded(F.slice("_cc", F.lit(1), cn))})
    qn, cn = F.size("_qi"), F.size("_ci")
    used = qn + cn + 3
    pad = F.greatest(F.lit(max_length) - used, F.lit(0))
    cls, sep = F.array(F.lit(CLS_ID)), F.array(F.lit(SEP_ID))
    input_ids = F.concat(cls, F.col("_qi"), sep, F.col("_ci"), sep, F.array_repeat(F.lit(PAD_ID), pad))
    types = F.concat(F.array_repeat(F.lit(0), qn + 2), F.array_repeat(F.lit(1), cn + 1), F.array_repeat(F.lit(0), pad))
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), pad))
    return base.select(*base.columns[:-4], input_ids.alias("input_ids"), types.alias("token_type_ids"),
                       mask.alias("attention_mask"))


def group_rows(encoded: DataFrame, group_size: int = 10, order: Sequence[str] = ("source_type", "context_id")) -> DataFrame:
    """One row per qid with exactly ``group_size`` rows and one positive:
    arrays of the encoded rows in (order) order, labels and the target index.

    Group sizes are checked with a partial aggregate first: any other group
    raises (V5) before its rows are collected.
    """
    sizes = encoded.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("npos"))
    good = (F.col("n") == group_size) & (F.col("npos") == 1)
    checked = sizes.select("qid", F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit("group "), F.col("qid").cast("string"), F.lit(f" must have {group_size} rows and one positive"))))
        .cast("boolean").alias("good"))
    ok = encoded.join(checked, "qid").where("good")
    packed = ok.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(
        *[F.col(o) for o in order], "label", "input_ids", "token_type_ids", "attention_mask"))).alias("_g"))
    return packed.select(
        "qid", F.col("_g.label").alias("labels"),
        (F.array_position(F.col("_g.label"), 1) - 1).cast("int").alias("target"),
        F.col("_g.input_ids").alias("input_ids"), F.col("_g.token_type_ids").alias("token_type_ids"),
        F.col("_g.attention_mask").alias("attention_mask"))
