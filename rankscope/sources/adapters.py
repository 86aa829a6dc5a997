"""Adapters: map the driver tables onto the reference's data model.

* ranked   -- lineitem lines as candidate groups, three scoring methods
* qa       -- conversations: user turn -> next assistant turn
* corpus   -- documents split into (title, ask, answer)
* vectors  -- embeddings as dense question/context vectors
* judged   -- labels joined to documents for classification metrics
* runs     -- events as per-run epoch logs
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankscope.functions.text import clean_text
from rankscope.operators.ranking import hot_group_rows, total_and_most
from rankscope.session import join_where_dealt, spread
from rankscope.sources.tables import table

# method name -> aggregated lineitem column used as its score
RANKED_METHODS = (("embedding_baseline", "s_price"), ("bce", "s_qty"), ("lightweight_ml", "s_disc"))


def ranked_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """The columns of lineitem that make the groups, and whether the lines are dealt by order.

    They are, in one exchange that serves all joins and windows by qid, unless an order is hot.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag",
               "l_extendedprice", "l_quantity", "l_discount")
    limit = hot_group_rows(spark) // len(RANKED_METHODS)
    total, most = total_and_most(li, ["l_orderkey"], limit)
    rows = len(RANKED_METHODS) * total  # a row for each method follows
    if most > limit:
        return spread(li, rows, "l_orderkey", "l_linenumber"), False
    join_where_dealt(spark)
    out = spread(li, rows, "l_orderkey")
    return li.repartition("l_orderkey") if out is li else out, True


def grouped_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("context_id")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("label"),
        F.max("l_extendedprice").alias("s_price"), F.max("l_quantity").alias("s_qty"),
        F.max("l_discount").alias("s_disc"))


def ranked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, context_id, label, s_price, s_qty, s_disc) -- one row per order line key.

    (l_orderkey, l_linenumber) is not unique, so lines are aggregated first.
    """
    return grouped_lines(ranked_lines(spark, sf_dir)[0])


def ranked_candidates(groups: DataFrame) -> DataFrame:
    return groups.select("qid", "context_id", "label")


def ranked_raw_scores(groups: DataFrame) -> DataFrame:
    """Long (qid, context_id, method, score, latency_ms) for the three methods."""
    stacked = groups.select("qid", "context_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("score"))
        for m, c in RANKED_METHODS])).alias("m"))
    return stacked.select("qid", "context_id", "m.method", "m.score", F.lit(0.0).alias("latency_ms"))


def qa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw QA rows (department, title, ask, answer, conv_id, turn).

    ask = a user turn, answer = the assistant turn right after it in the same
    conversation, title = the conversation's system turn (or ''), department =
    parity of conv_id.  (conv_id, turn) is the load order.
    """
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ask"))
    asst = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    system = (conv.where(F.col("role") == "system")
              .groupBy("conv_id").agg(F.min_by("text", "turn").alias("title")))
    pairs = user.join(asst, ["conv_id", "turn"]).join(system, "conv_id", "left")
    return pairs.select(
        F.when(F.col("conv_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("department"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"), "ask", "answer", "conv_id", "turn")


def corpus_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw QA rows from documents: department = lang, title = source,
    ask = first 120 chars of the cleaned text, answer = the rest."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    t = clean_text("text")
    return docs.select(F.col("lang").alias("department"), F.col("source").alias("title"),
                       F.substring(t, 1, 120).alias("ask"),
                       F.substring(t, 121, 2147483647).alias("answer"),
                       F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding array<float>, department = label)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select("vec_id", "embedding", F.col("label").cast("string").alias("department"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to documents: label = quality, score = n_chars-based probability."""
    lab = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang")
    j = lab.join(docs, "doc_id")
    # logit centred at 2,000 characters, 1,000 characters per unit
    logit = (F.col("n_chars").cast("double") - 2000.0) / 1000.0
    return j.select("doc_id", F.col("lang").alias("group"), F.col("quality").alias("label"),
                    logit.alias("logit"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("prob"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as epoch logs: run_id = user_id, epoch = order of (ts, event_id), metric = value."""
    from rankscope.operators.ranking import number_within

    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    numbered = number_within(ev.withColumnRenamed("user_id", "run_id"), ["run_id"],
                             [F.col("ts").asc(), F.col("event_id").asc()], "epoch")
    return numbered.select("run_id", F.col("epoch").cast("long").alias("epoch"), F.col("value").alias("metric"))
