"""Numeric helpers: coercion, rounding, capped lengths, ratios, logistic maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "to_double_or", "round_metric", "capped_length", "length_ratio",
    "match_indicator", "sigmoid", "softplus", "nan_to_null",
]


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def to_double_or(x: Column | str, default: float = 0.0) -> Column:
    """Lenient number: unparsable, missing or NaN -> default."""
    d = _c(x).try_cast("double")
    return F.coalesce(F.nanvl(d, F.lit(default)), F.lit(default))


def nan_to_null(x: Column | str) -> Column:
    c = _c(x).cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def round_metric(x: Column | str, places: int = 4) -> Column:
    """Half-even rounding of a metric."""
    return F.bround(_c(x).cast("double"), places)


def capped_length(x: Column | str, cap: int) -> Column:
    """clip(len(x), 0, cap) / cap; missing text counts as length 0."""
    n = F.coalesce(F.length(_c(x).cast("string")), F.lit(0))
    return F.least(n, F.lit(cap)).cast("double") / float(cap)


def length_ratio(a: Column | str, b: Column | str) -> Column:
    la = F.coalesce(F.length(_c(a).cast("string")), F.lit(0)).cast("double")
    lb = F.coalesce(F.length(_c(b).cast("string")), F.lit(0)).cast("double")
    hi = F.greatest(la, lb)
    return F.when(hi > 0, F.least(la, lb) / hi).otherwise(F.lit(0.0))


def match_indicator(a: Column | str, b: Column | str) -> Column:
    """1.0 when equal (two missing values match), else 0.0."""
    return _c(a).cast("string").eqNullSafe(_c(b).cast("string")).cast("double")


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def softplus(x: Column | str) -> Column:
    """Numerically stable log(1 + exp(x))."""
    c = _c(x)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))
