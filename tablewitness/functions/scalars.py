"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10

# Names that a careless export gives to columns.
SUSPICIOUS_NAME = r"(unnamed|col_\d+|var_\d+)"
# Fixed value: what marks an address as a dataset page.
DATASET_PAGE_MARKER = "kaggle.com/datasets/"


def finite_or(value: Column, default: float) -> Column:
    """``value`` unless it is null, NaN or infinite."""
    value = value.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(value)


def not_nan(value: Column) -> Column:
    """Null instead of NaN, so that aggregates skip it."""
    return F.when(~F.isnan(value), value)


def total(columns: Sequence[Column]) -> Column:
    """Sum of columns, left to right."""
    return reduce(lambda a, b: a + b, columns)


def entropy_term(p: Column, eps: float) -> Column:
    """One summand of a Shannon entropy in bits."""
    return -p * F.log2(p + F.lit(eps))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def corrected_skewness(g1: Column, n: Column) -> Column:
    """Sample skewness with bias correction, from the population value."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis with bias correction, from the population value."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate over the rows where both are present; null when one side is constant.

    The built-in one fails on constant columns in ANSI mode.
    """
    sxx, syy = F.regr_sxx(y, x), F.regr_syy(y, x)
    return F.when((sxx > 0) & (syy > 0), F.regr_sxy(y, x) / (F.sqrt(sxx) * F.sqrt(syy)))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope aggregate; null when ``x`` does not vary."""
    sxx = F.regr_sxx(y, x)
    return F.when(sxx > 0, F.regr_sxy(y, x) / sxx)


def suspicious_name(name: Column) -> Column:
    return F.lower(name).rlike(SUSPICIOUS_NAME)


def is_dataset_page(url: Column) -> Column:
    return url.contains(DATASET_PAGE_MARKER)


def dataset_slug(url: Column) -> Column:
    """``owner/name`` behind the last ``datasets/``; empty when there is no second part."""
    trimmed = F.regexp_replace(url, r"^/+|/+$", "")
    parts = F.split(F.regexp_replace(trimmed, r"^.*datasets/", ""), "/")
    return F.when(F.size(parts) > 1, F.concat_ws("/", parts[0], parts[1])).otherwise(F.lit(""))


def shuffle_key(seed: int, tag: str, keys: Sequence[str]) -> Column:
    """A pseudo-random text that orders rows, equal in every engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[F.col(k).cast("string") for k in keys]))


def unit_hash(seed: int, tag: str, keys: Sequence[str]) -> Column:
    """A pseudo-random number in [0, 1) per row, from the first 52 bits of md5."""
    return F.conv(F.substring(shuffle_key(seed, tag, keys), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def normal_hash(seed: int, tag: str, keys: Sequence[str]) -> Column:
    """A pseudo-random standard normal per row (Box-Muller on two hashes)."""
    u = F.lit(1.0) - unit_hash(seed, tag + "#r", keys)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.lit(3.141592653589793) * unit_hash(seed, tag + "#a", keys))
