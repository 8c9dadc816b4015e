"""Numeric cleaning and adjusted-price arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def to_number(c: Column, default: float | None = None) -> Column:
    """Text to double; unreadable text gives null, or `default`."""
    v = c.try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(default))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def choice(c: Column, allowed: list[str], default: str) -> Column:
    """The value if it is one of `allowed`, else `default` (also for null)."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(*allowed), t).otherwise(F.lit(default))


def pct_change(now: Column, before: Column) -> Column:
    """Percent change; null where the base is null or 0."""
    return (F.try_divide(now, before) - 1) * 100


def turnover(volume: Column, shares_10k: Column) -> Column:
    """Turnover in percent of `shares_10k` ten-thousands of outstanding shares."""
    return F.try_divide(volume, shares_10k * 10000) * 100


def adjusted(price: Column, factor: Column, digits: int = 2) -> Column:
    return F.round(price * factor, digits)


def fmt_number(c: Column, digits: int = 2) -> Column:
    """Thousands-separated text; a dash for null and NaN."""
    return F.coalesce(F.format_number(finite(c), digits), F.lit("—"))
