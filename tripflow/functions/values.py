"""Null-safe numbers: tolerant casts, guarded ratios, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tolerant_int(text: Column) -> Column:
    """Integer, or null where the text is none (ANSI casts would fail the job)."""
    return text.try_cast("int")


def tolerant_double(text: Column) -> Column:
    return text.try_cast("double")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, or null where the divisor is zero or null."""
    return F.try_divide(numerator, denominator)


def null_to_zero(amount: Column) -> Column:
    """Money with missing or unreadable values taken as 0."""
    return F.coalesce(amount.try_cast("double"), F.lit(0.0))


def imbalance(left: Column, right: Column) -> Column:
    """How many times the larger count exceeds the smaller (taken as at least 1), 6 digits."""
    larger, smaller = F.greatest(left, right), F.least(left, right)
    return F.round(larger / F.greatest(F.lit(1), smaller), 6)
