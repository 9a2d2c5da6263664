"""Scalar column expressions.

All of them are built-in functions, so they stay inside whole-stage codegen and can be pushed,
pruned and folded by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decision labels, contribution labels, label clean-up and the "no date" marker.
REJECTED = "Rejetée"
ACCEPTED = "Acceptée"
UNFAVOURABLE = "Défavorable"
FAVOURABLE = "Favorable"
LABEL_STRIP_CHARS = "<= 0.00 0.46"
LABEL_LENGTH = 25
NO_DATE = 365243

INFINITY = float("inf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or NULL when it is NaN or infinite.  NaN sorts above every number in Spark, so one
    comparison covers both."""
    c = _col(c)
    return F.when(F.abs(c) < F.lit(INFINITY), c)


def ieee_div(n: Column | str, d: Column | str, on_zero: str = "ieee") -> Column:
    """Floating-point division that gives a signed infinity for x/0 and NULL for 0/0.

    ANSI mode raises on a zero divisor and ``try_divide`` hides it; ratio features need the infinity
    so that one bad payment marks its whole group.  ``on_zero="null"`` is the robust variant.
    """
    n, d = _col(n).cast("double"), _col(d).cast("double")
    quotient = F.try_divide(n, d)
    if on_zero == "null":
        return quotient
    if on_zero != "ieee":
        raise ValueError(f"on_zero must be 'ieee' or 'null', not {on_zero!r}")
    # pow(±0, -1) is ±Infinity, so the sign of a zero divisor is respected; 0 * Infinity is NaN.
    at_zero = F.nanvl(n * F.pow(d, F.lit(-1.0)), F.lit(None).cast("double"))
    return F.when(d == F.lit(0.0), at_zero).otherwise(quotient)


def null_sentinel(c: Column | str, sentinel: float = NO_DATE) -> Column:
    """NULL where the column holds the marker value."""
    return F.nullif(_col(c), F.lit(sentinel))


def clamp_zero(c: Column | str) -> Column:
    """Values below zero, missing ones included, become zero."""
    return F.greatest(finite(_col(c).cast("double")), F.lit(0.0))


def round_half_even(c: Column | str, digits: int) -> Column:
    """Rounding with ties to the even digit, on the decimal digits shown for the value."""
    return F.bround(_col(c), digits)


def truncate_percent(part: Column | str, whole: Column | str) -> Column:
    """Whole percent of ``part`` in ``whole``, cut not rounded.  Integer arithmetic: 45 missing of 100
    is exactly 55."""
    return F.floor((_col(part) * F.lit(100)) / F.nullif(_col(whole), F.lit(0))).cast("int")


def above(score: Column | str, threshold: Column | float) -> Column:
    """1 when the score is strictly above the threshold, else 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_col(score) > t).cast("int")


def decide(score: Column | str, threshold: Column | float) -> Column:
    """Decision label.  The comparison is strict and on the unrounded score."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(_col(score) > t, F.lit(REJECTED)).otherwise(F.lit(ACCEPTED))


def sign_label(value: Column | str) -> Column:
    """Whether a contribution speaks for a rejection or for an acceptance."""
    return F.when(_col(value) > 0, F.lit(UNFAVOURABLE)).otherwise(F.lit(FAVOURABLE))


def clean_label(c: Column | str) -> Column:
    """Feature label for display: the comparison characters stripped from both ends, 25 characters."""
    return F.substring(F.btrim(_col(c), F.lit(LABEL_STRIP_CHARS)), 1, LABEL_LENGTH)


def ascii_upper_name(*parts: Column | str) -> Column:
    """``a_B``: every part but the first in upper case, joined by underscores."""
    first, *rest = [_col(p) for p in parts]
    return F.concat_ws("_", first, *[F.upper(p) for p in rest])


def score_band(score: Column | str, threshold: Column | float) -> Column:
    """Gauge band of a score: ``low`` up to the threshold, ``high`` from it on."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(_col(score) < t, F.lit("low")).otherwise(F.lit("high"))


def hash_bucket(key: Column | str, buckets: int, salt: str = "") -> Column:
    """Bucket 0..buckets-1 of a key, from its MD5: the same on every engine, run and partitioning."""
    text = _col(key).cast("string")
    if salt:
        text = F.concat_ws("|", text, F.lit(salt))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def add_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]], on_zero: str = "ieee") -> DataFrame:
    """Add several ratio columns in one projection."""
    return df.withColumns({name: ieee_div(n, d, on_zero) for name, (n, d) in ratios.items()})
