"""Rounding and ratio rules shared by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, half-even; 0 when there is nothing to divide by."""
    ratio = F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))
    return F.coalesce(F.bround(ratio, 1), F.lit(0.0))


def micro(usd: Column) -> Column:
    """USD -> whole micro-dollars, half-even."""
    return F.bround(usd * F.lit(1_000_000.0)).cast("long")


def per_month(amount: Column, days: Column) -> Column:
    """Scale an observed amount to 30 days; days are active days, at least one."""
    return amount * F.lit(30.0) / F.greatest(F.lit(1), days)
