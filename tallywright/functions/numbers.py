"""Percentages, recency bands and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(numerator: Column, denominator: Column) -> Column:
    """Share in percent with two decimals; 0 when there is nothing to divide by.

    The division is done on decimals and ties go to the even digit, so the
    result does not depend on binary rounding noise.
    """
    whole = denominator.cast("decimal(19,0)")
    share = numerator.cast("decimal(19,0)") * 100 / F.nullif(whole, F.lit(0).cast("decimal(19,0)"))
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.bround(share, 2).cast("double"))


def count_where(condition: Column) -> Column:
    """Number of rows where the condition holds, 0 on no rows."""
    return F.count(F.when(condition, F.lit(1)))


def recency_band(recency_days: Column, thresholds: Sequence[int]) -> Column:
    """Ordinal of the right-closed band: 0 up to the first threshold, and so on."""
    band = F.lit(len(thresholds))
    for ordinal in reversed(range(len(thresholds))):
        band = F.when(recency_days <= thresholds[ordinal], F.lit(ordinal)).otherwise(band)
    return F.when(recency_days > -1, band)


def band_labels(thresholds: Sequence[int]) -> list[str]:
    """Display labels of the bands in order."""
    lower = [0] + [threshold + 1 for threshold in thresholds[:-1]]
    labels = [f"{low}–{high} days" for low, high in zip(lower, thresholds, strict=True)]
    return [*labels, scenario_label(thresholds[-1])]


def scenario_label(threshold: int) -> str:
    """Display label of one recency scenario."""
    return f"More than {threshold} days"
