"""Text functions: cleaning, context building, ids, character sets and n-grams.

All functions return Spark Columns.  All but ``keyword_overlap`` are built from
built-in expressions so they stay inside whole-stage code generation.  Lengths
and slices are code-point based.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "WHITESPACE_CLASS", "KEPT_CHAR_CLASS", "CONTEXT_LABELS",
    "ONCOLOGY_PATH_KEYWORDS", "PEDIATRIC_PATH_KEYWORDS",
    "ONCOLOGY_QUESTION_KEYWORDS", "PEDIATRIC_QUESTION_KEYWORDS",
    "clean_text", "make_context", "keyword_label", "truncate_text", "prefix",
    "answer_key", "format_id", "kept_chars", "char_bigrams", "set_jaccard",
    "char_set", "answer_jaccard", "keyword_overlap", "chars", "col_of",
]

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
# Whitespace as Python's str.isspace() defines it: tab, LF, VT, FF, CR,
# U+001C..U+001F, space, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028,
# U+2029, U+202F, U+205F, U+3000.  Written so both Java regex and RE2 accept it.
WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Characters kept for bigram keyword overlap: CJK U+4E00..U+9FFF, A-Z, a-z, 0-9.
KEPT_CHAR_CLASS = r"[\x{4E00}-\x{9FFF}A-Za-z0-9]"
# Context part labels, in order: title, patient question, doctor answer.
CONTEXT_LABELS = ("标题：", "患者问题：", "医生回答：")
# Department keywords matched against a lower-cased path or name.
ONCOLOGY_PATH_KEYWORDS = ("oncology", "肿瘤", "癌", "瘤")
PEDIATRIC_PATH_KEYWORDS = ("pediatric", "pediatrics", "儿科", "小儿", "新生儿", "营养保健")
# Department keywords matched against a lower-cased question.
ONCOLOGY_QUESTION_KEYWORDS = ("癌", "肿瘤", "化疗", "放疗", "甲状腺", "肺癌", "胃癌", "乳腺")
PEDIATRIC_QUESTION_KEYWORDS = ("小儿", "儿童", "宝宝", "婴儿", "孩子", "新生儿", "发烧", "腹泻")
# ---------------------------------------------------------------------------


def col_of(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x: Column | str) -> Column:
    """null -> '', every whitespace run (incl. CR/LF) -> one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col_of(x).cast("string"), F.lit("")),
                                   WHITESPACE_CLASS + "+", " "))


def make_context(title: Column | str, ask: Column | str, answer: Column | str,
                 max_chars: int = 900) -> Column:
    """Labelled, cleaned parts joined by one space, empty parts skipped, cut to max_chars.

    The cut is not followed by a second trim, so a trailing space can survive.
    """
    parts = []
    for label, value in zip(CONTEXT_LABELS, (title, ask, answer)):
        v = clean_text(value)
        parts.append(F.when(v != "", F.concat(F.lit(label), v)))
    return F.substring(F.concat_ws(" ", *parts), 1, max_chars)


def keyword_label(x: Column | str, rules: Sequence[tuple[str, Sequence[str]]],
                  default: str = "unknown") -> Column:
    """First rule whose keyword occurs in lower(clean(x)) names the label."""
    v = F.lower(clean_text(x))
    expr = F.lit(default)
    for label, words in reversed(list(rules)):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(v, F.lit(w))
        expr = F.when(hit, F.lit(label)).otherwise(expr)
    return expr


def truncate_text(x: Column | str, max_chars: int) -> Column:
    """null -> ''; unchanged when max_chars <= 0 or short enough; else cut + '...'."""
    s = F.coalesce(col_of(x).cast("string"), F.lit(""))
    if max_chars <= 0:
        return s
    return F.when(F.length(s) <= max_chars, s).otherwise(
        F.concat(F.substring(s, 1, max_chars), F.lit("...")))


def prefix(x: Column | str, n: int = 900) -> Column:
    return F.substring(col_of(x).cast("string"), 1, n)


def answer_key(x: Column | str) -> Column:
    return F.lower(clean_text(x))


def format_id(prefix_: str | Column, n: Column | str, width: int) -> Column:
    """'{prefix}{n:0{width}d}' (numbers wider than width are kept whole)."""
    if isinstance(prefix_, str):
        return F.format_string(prefix_.replace("%", "%%") + f"%0{width}d", col_of(n))
    return F.format_string(f"%s%0{width}d", prefix_, col_of(n))


def kept_chars(x: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col_of(x).cast("string"), F.lit("")),
                                F.lit(KEPT_CHAR_CLASS), 0)


def char_bigrams(x: Column | str) -> Column:
    """Set of adjacent pairs of kept characters; one char -> itself; none -> []."""
    ch = kept_chars(x)
    pairs = F.zip_with(ch, F.slice(ch, 2, F.size(ch)), lambda a, b: F.concat(a, b))
    return F.when(F.size(ch) < 2, F.array_distinct(ch)).otherwise(
        F.array_distinct(F.filter(pairs, lambda p: p.isNotNull())))


def set_jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b|; 0.0 when either set is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


#: Sets of bigrams that a task keeps for its next pairs.
KEPT_SETS = 256
#: Whether the character of a code point of the basic plane, which has all of them, is a kept one.
_KEPT = np.array([re.match(re.sub(r"\\x\{(\w+)\}", r"\\u\1", KEPT_CHAR_CLASS), chr(i)) is not None for i in range(1 << 16)])


def bigram_set(text: str) -> frozenset:
    """The set of ``char_bigrams``, a pair of kept characters as one number."""
    c = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    c = c[_KEPT[c]].astype(np.uint32)  # no half of a surrogate pair is a kept character
    return frozenset((c if len(c) < 2 else (c[:-1] << 16) | c[1:]).tolist())


def keyword_overlap(q: Column | str, c: Column | str) -> Column:
    """Jaccard of the ``char_bigrams`` of two texts; 0.0 when either has none.

    Arrays of a thousand strings a text cost milliseconds a pair, so a task
    makes sets of numbers and keeps them for the next pairs with the text.
    """

    @F.pandas_udf("double")
    def overlap(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        kept: dict[str, frozenset] = {}

        def bigrams(text: str) -> frozenset:
            if text not in kept:
                if len(kept) >= KEPT_SETS:
                    del kept[next(iter(kept))]
                kept[text] = bigram_set(text)
            return kept[text]

        for left, right in batches:
            values = []
            for a, b in zip(left, right):
                x, y = bigrams(a), bigrams(b)
                both = len(x & y)
                values.append(both / (len(x) + len(y) - both) if x and y else 0.0)
            yield pd.Series(values, dtype="float64")

    return overlap(*[F.coalesce(col_of(x).cast("string"), F.lit("")) for x in (q, c)])


def chars(x: Column | str) -> Column:
    """Code points of a string as an array; '' -> []."""
    s = col_of(x)
    return F.filter(F.split(s, ""), lambda c: c != "")


def char_set(x: Column | str) -> Column:
    """Distinct characters of lower(clean(x)) without the space."""
    return F.array_distinct(F.filter(F.split(answer_key(x), ""), lambda c: (c != " ") & (c != "")))


def answer_jaccard(a: Column | str, b: Column | str) -> Column:
    return set_jaccard(char_set(a), char_set(b))
