"""Scalar Column expressions: number parsing, codes, buckets, losses."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts read as "missing".
MISSING_TEXTS = ["", "nan", "NaN", "NONE", "None", "null"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a computed value several times but compute it once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Leading and trailing white space of any kind removed."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def to_double(c: Column) -> Column:
    """Number or NULL: unparsable text, NaN and infinities become NULL."""
    v = c.try_cast("double")
    # one range test keeps NaN (which sorts above every number) and infinities out
    return F.when(v.between(-1.7976931348623157e308, 1.7976931348623157e308), v)


def number_prefix(c: Column) -> Column:
    """Leading signed decimal of the trimmed text, else NULL."""
    return F.regexp_extract(c.cast("string"), r"(?U)^\s*(-?\d+(\.\d+)?)", 1).try_cast("double")


def missing_to_null(c: Column) -> Column:
    """Trimmed text; the usual spellings of "missing" become NULL."""
    return let(strip(c), lambda t: F.when(~t.isin(MISSING_TEXTS), t))


def token_to_int(c: Column, zero_tokens: list[str]) -> Column:
    """"none seen" tokens and anything unparsable count as 0."""
    number = let(strip(c), lambda t: F.when(t.isin(zero_tokens), 0.0).otherwise(to_double(t)))
    return F.coalesce(number, F.lit(0.0)).cast("int")


def binarize(c: Column, threshold: Column | float) -> Column:
    """1 when the score reaches the threshold, 0 below, NULL stays NULL."""
    return F.when(c.isNotNull(), (c >= threshold).cast("int"))


def round_binary(c: Column) -> Column:
    """Generated 0/1 column back to integers; NULL counts as 0."""
    return F.when(to_double(c) >= 0.5, 1).otherwise(0)


def map_label(c: Column, mapping: dict[str, str]) -> Column:
    """Display name of a code; unmapped codes pass through."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c) if pairs else c


def replace_tokens(c: Column, mapping: dict[str, str]) -> Column:
    """Replace every token, longest first, then tidy separators."""
    tokens = sorted(mapping, key=len, reverse=True)
    named = reduce(lambda acc, t: F.replace(acc, F.lit(t), F.lit(mapping[t])), tokens, c)
    return F.regexp_replace(F.regexp_replace(named, r"_+", "_"), r"^_|_$", "")


def strength_label(r: Column) -> Column:
    """Correlation size in words: |r| cut at 0.7, 0.4 and 0.2, with sign."""
    size = (F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.4, "moderate")
            .when(F.abs(r) >= 0.2, "weak").otherwise("very weak"))
    sign = F.when(r >= 0, "positive").otherwise("negative")
    return F.when(r.isNull(), "not computable").otherwise(F.concat_ws(" ", size, sign))


def present(c: Column) -> Column:
    """NULL when the text says "missing", else the value as text."""
    t = c.cast("string")
    return F.when(~F.lower(F.trim(t)).isin("", "nan", "none", "null", "infinity", "-infinity", "inf", "-inf"), t)


def first_present(*cols: Column) -> Column:
    """First argument that is not missing in any of its spellings."""
    return F.coalesce(*[present(c) for c in cols])


def shift_clip(c: Column, delta: Column | float, lo: float | None = 0.0, hi: float | None = None) -> Column:
    """``c + delta`` kept inside [lo, hi]; NULL stays NULL."""
    v = c + delta
    if lo is not None:
        v = F.when(v < lo, F.lit(float(lo))).otherwise(v)
    if hi is not None:
        v = F.when(v > hi, F.lit(float(hi))).otherwise(v)
    return F.when(c.isNotNull(), v)


def clipped_probability(p: Column, eps: float = 1e-12) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def log_loss(y: Column, p: Column) -> Column:
    q = clipped_probability(p)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def focal_loss(y: Column, p: Column, alpha: float, gamma: float) -> Column:
    """Focal loss of one row; rows without a label contribute 0."""
    a = min(max(float(alpha), 1e-6), 1 - 1e-6)
    g = max(0.0, float(gamma))
    q = clipped_probability(p)
    return (F.when(y == 1, -a * F.pow(1 - q, F.lit(g)) * F.ln(q))
            .when(y == 0, -(1 - a) * F.pow(q, F.lit(g)) * F.ln(1 - q))
            .otherwise(0.0))


def tail_weight(y: Column, high: float = 4.0, high_weight: float = 2.5,
                severe: float = 7.0, severe_weight: float = 4.0) -> Column:
    """Sample weight of the rare high tail; severe never weighs less than high."""
    hw = max(1.0, float(high_weight))
    sw = max(hw, float(severe_weight))
    return F.when(y >= severe, sw).when(y >= high, hw).otherwise(1.0)


def half_even(c: Column) -> Column:
    """Round half to even, as an integer."""
    return F.bround(c, 0).cast("long")


def sanitize_text(name: str, fallback: str = "unknown") -> str:
    """Column-name form of a label (driver side)."""
    s = re.sub(r"[^0-9A-Za-z一-鿿]+", "_", re.sub(r"\s+", "", str(name))).strip("_")
    return s or fallback
