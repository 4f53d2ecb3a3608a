"""Calendar arithmetic on date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days from the earlier to the later date."""
    return F.datediff(later, earlier).cast("bigint")


def days_inclusive(earlier: Column, later: Column) -> Column:
    """Days from the earlier to the later date, counting both ends."""
    return (F.datediff(later, earlier) + 1).cast("bigint")


def month_start(day: Column) -> Column:
    """First day of the month."""
    return F.trunc(day, "month")
