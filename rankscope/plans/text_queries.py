"""Text-operator queries over the qa and corpus adapters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankscope.functions.text import (ONCOLOGY_PATH_KEYWORDS, PEDIATRIC_PATH_KEYWORDS, answer_jaccard,
                                      answer_key, char_bigrams, clean_text, keyword_label, keyword_overlap,
                                      make_context, prefix, truncate_text)
from rankscope.operators.corpus import CORPUS_COLUMNS, load_qa
from rankscope.plans import sql_text as S
from rankscope.plans.catalog import register
from rankscope.sources.adapters import corpus_raw, qa_raw

ORDER = ["conv_id", "turn"]

# Keyword table used by the department_rules query (a parameter of P3/P4).
LANGUAGE_RULES = (("en", (" the ", " and ")), ("fr", (" le ", " la ", " et ")),
                  ("de", (" der ", " die ", " und ")), ("es", (" el ", " los ", " y ")))
PATH_RULES = (("oncology", ONCOLOGY_PATH_KEYWORDS), ("pediatrics", PEDIATRIC_PATH_KEYWORDS))


def qa_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_qa(qa_raw(spark, sf_dir), ORDER)


def documents_corpus(spark: SparkSession, sf_dir: str, features: Mapping[str, Column] | None = None) -> DataFrame:
    return load_qa(corpus_raw(spark, sf_dir), ORDER, features=features)


@register("clean_text", f"""
WITH {S.QA_RAW_CTE}
SELECT conv_id, turn, {S.clean('title')} AS title, {S.clean('ask')} AS ask, {S.clean('answer')} AS answer,
       {S.context('title', 'ask', 'answer')} AS context, lower({S.clean('answer')}) AS answer_key
FROM qa_raw""")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = qa_raw(spark, sf_dir)
    return r.select("conv_id", "turn", clean_text("title").alias("title"), clean_text("ask").alias("ask"),
                    clean_text("answer").alias("answer"), make_context("title", "ask", "answer").alias("context"),
                    answer_key("answer").alias("answer_key"))


@register("corpus_load", f"WITH {S.QA_RAW_CTE}, {S.load_cte('qa_raw', 'corpus')} "
                         f"SELECT {', '.join(CORPUS_COLUMNS)} FROM corpus")
def q_corpus_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_corpus(spark, sf_dir).select(*CORPUS_COLUMNS)


@register("corpus_documents", f"WITH {S.CORPUS_RAW_CTE}, {S.load_cte('corpus_raw', 'corpus')} "
                              f"SELECT {', '.join(CORPUS_COLUMNS)} FROM corpus")
def q_corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_corpus(spark, sf_dir).select(*CORPUS_COLUMNS)


def _label_sql(x: str, rules) -> str:
    v = f"lower({S.clean(x)})"
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({v}, '{w}')" for w in words) + f" THEN '{lab}'" for lab, words in rules)
    return f"CASE {whens} ELSE 'unknown' END"


@register("department_rules", f"""
SELECT doc_id, lang, {_label_sql('source', PATH_RULES)} AS path_department,
       {_label_sql('text', LANGUAGE_RULES)} AS text_department
FROM documents""")
def q_department_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return d.select("doc_id", "lang", keyword_label("source", PATH_RULES).alias("path_department"),
                    keyword_label("text", LANGUAGE_RULES).alias("text_department"))


@register("truncate_text", """
SELECT doc_id,
       CASE WHEN length(coalesce(text, '')) <= 500 THEN coalesce(text, '')
            ELSE substring(text, 1, 500) || '...' END AS short_text,
       substring(text, 1, 900) AS prompt, length(substring(text, 1, 900)) AS prompt_chars
FROM documents""")
def q_truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", truncate_text("text", 500).alias("short_text"), prefix("text", 900).alias("prompt"),
                    F.length(prefix("text", 900)).alias("prompt_chars"))


@register("bigram_overlap", f"""
WITH {S.QA_RAW_CTE}
SELECT conv_id, turn, CAST(len({S.bigrams('ask')}) AS INTEGER) AS ask_bigrams,
       CAST(len({S.bigrams('answer')}) AS INTEGER) AS answer_bigrams,
       round({S.jaccard(S.bigrams('ask'), S.bigrams('answer'))}, 6) AS keyword_overlap
FROM qa_raw""")
def q_bigram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = qa_raw(spark, sf_dir)
    return r.select("conv_id", "turn", F.size(char_bigrams("ask")).alias("ask_bigrams"),
                    F.size(char_bigrams("answer")).alias("answer_bigrams"),
                    F.round(keyword_overlap("ask", "answer"), 6).alias("keyword_overlap"))


@register("answer_jaccard", f"""
WITH {S.QA_RAW_CTE}
SELECT conv_id, turn, round({S.jaccard(S.char_set('ask'), S.char_set('answer'))}, 6) AS answer_jaccard
FROM qa_raw""")
def q_answer_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = qa_raw(spark, sf_dir)
    return r.select("conv_id", "turn", F.round(answer_jaccard("ask", "answer"), 6).alias("answer_jaccard"))
