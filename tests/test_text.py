"""Text functions on hand-made rows with literal expected values."""

import pytest

from rankscope.functions import text as T

CLEAN = [(None, ""), ("", ""), (" ", ""), ("a", "a"), ("  Hello\r\n  World\t ", "Hello World"),
         ("x\u3000y z", "x y z"), ("甲状腺癌 AB12 cd", "甲状腺癌 AB12 cd"), ("emoji \U0001F600 here", "emoji \U0001F600 here"),
         ("\x1c\x1dsep\x1f", "sep"), ("line1\nline2\n\nline3", "line1 line2 line3")]
BIGRAMS = [(None, []), ("a", ["a"]), ("一", ["一"]), ("Ab", ["Ab"]), ("x y z", ["xy", "yz"]),
           ("甲状腺癌 A1", ["1", "A1", "甲状", "状腺", "腺癌", "癌A"][1:]), ("aaaa", ["aa"]), ("a-b", ["ab"]), ("!?", [])]
CHARACTERS = [(None, ""), ("Ab bA", "ab"), ("a  \n b", "ab"), ("儿 科", "儿科")]
#: left, right, overlap of bigrams, overlap of characters
PAIRS = [("abc", "abd", 1 / 3, 2 / 4), ("abc", "abc", 1.0, 1.0), ("abc", None, 0.0, 0.0), ("", "", 0.0, 0.0),
         ("a", "a", 1.0, 1.0), ("ab", "ba", 0.0, 1.0), ("Abcd", "abcd", 2 / 4, 1.0), ("儿科发烧", "发烧", 1 / 3, 2 / 4)]


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def test_clean_text(spark):
    got = column(spark, [r for r, _ in CLEAN]).select("i", T.clean_text("t").alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [w for _, w in CLEAN]


def test_bigrams(spark):
    got = column(spark, [r for r, _ in BIGRAMS]).select("i", T.char_bigrams("t").alias("b")).orderBy("i").collect()
    assert [sorted(r.b) for r in got] == [sorted(w) for _, w in BIGRAMS]


def test_character_sets(spark):
    got = column(spark, [r for r, _ in CHARACTERS]).select("i", T.char_set("t").alias("c")).orderBy("i").collect()
    assert [sorted(r.c) for r in got] == [sorted(w) for _, w in CHARACTERS]


def test_overlaps(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(PAIRS)], "i int, a string, b string")
    got = df.select("i", T.keyword_overlap("a", "b").alias("k"), T.answer_jaccard("a", "b").alias("j"))
    for r in got.collect():
        assert (r.k, r.j) == pytest.approx(PAIRS[r.i][2:])


def test_make_context_and_truncate(spark):
    one, two, three = T.CONTEXT_LABELS
    rows = [("T", "ask me", "answer"), (None, " q ", ""), ("", "", ""), ("x" * 10, "y" * 950, "z")]
    want = [f"{one}T {two}ask me {three}answer", f"{two}q", "", f"{one}xxxxxxxxxx {two}".ljust(900, "y")]
    df = spark.createDataFrame(rows, "t string, a string, b string")
    assert [r.c for r in df.select(T.make_context("t", "a", "b").alias("c")).collect()] == want
    tr = [r.x for r in df.select(T.truncate_text("a", 5).alias("x")).collect()]
    assert tr == ["ask m...", " q ", "", "yyyyy..."]
    assert [r.x for r in df.select(T.truncate_text("t", 0).alias("x")).collect()] == ["T", "", "", "x" * 10]


def test_keyword_label_first_rule_wins(spark):
    df = spark.createDataFrame([("Oncology and Pediatrics",), ("小儿科",), ("none",), (None,)], "v string")
    rules = (("oncology", T.ONCOLOGY_PATH_KEYWORDS), ("pediatrics", T.PEDIATRIC_PATH_KEYWORDS))
    got = [r.x for r in df.select(T.keyword_label("v", rules).alias("x")).collect()]
    assert got == ["oncology", "pediatrics", "unknown", "unknown"]


def test_format_id_keeps_long_numbers(spark):
    df = spark.createDataFrame([(5,), (1234567,)], "n int")
    assert [r.x for r in df.select(T.format_id("q", "n", 4).alias("x")).collect()] == ["q0005", "q1234567"]
