"""Exact repeats: groups of rows that agree on all repeat keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.numbers import count_where
from tallywright.sources.scratch import stage

# A list of repeated groups up to this long is broadcast whole.
BROADCAST_GROUPS = 1_000_000


def repeated_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key combinations that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def repeat_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated groups, excess rows and rows in such groups, one row."""
    groups = repeated_groups(df, keys)
    return groups.agg(
        F.count("*").alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("excess_duplicate_rows"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in_duplicate_groups"),
    )


def flag_repeats(
    df: DataFrame,
    keys: Sequence[str],
    flag: str,
    *,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """Add a flag to every row whose keys occur more than once.

    A window over the keys would bring each group into one task, and a single
    group may hold a third of the table. Groups are counted with partial
    aggregation instead, and the list of repeated groups is joined back. Its
    size is measured: a short list is broadcast and the rows stay where they
    are. A long list is cut in two. Groups of at least ``rows / limit`` rows
    number no more than the limit, so they are broadcast; the others are joined
    by shuffle, each small, while the rows already found are spread at random.
    """
    groups = stage(repeated_groups(df, keys), "repeated_groups")
    size = groups.agg(F.count("*").alias("groups"), F.sum("copies").alias("rows")).first()
    if size["groups"] <= broadcast_groups:
        found = _matches(df, F.broadcast(_named(groups, keys, "one")), keys, "one")
        return found.select(*df.columns, F.col("one").isNotNull().alias(flag))

    smallest_large = max(size["rows"] // broadcast_groups, 2)
    large = groups.filter(F.col("copies") > smallest_large)
    small = groups.filter(F.col("copies") <= smallest_large)
    found = _matches(df, F.broadcast(_named(large, keys, "in_large")), keys, "in_large")
    # The place is part of the join key: rows of a large group get one each and so
    # spread over all tasks, other rows have the place of their group.
    place = F.when(F.col("in_large").isNotNull(), F.monotonically_increasing_id())
    found = found.withColumn("place", place.otherwise(F.xxhash64(*keys)))
    rest = _named(small.withColumn("place", F.xxhash64(*keys)), [*keys, "place"], "in_small")
    found = _matches(found, rest, [*keys, "place"], "in_small")
    flagged = F.col("in_large").isNotNull() | F.col("in_small").isNotNull()
    return found.select(*df.columns, flagged.alias(flag))


def flag_integrity(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """The repeat profile next to the flagged rows, one row, from one pass."""
    return repeat_totals(repeat_counts(df, keys, flag))


def repeat_counts(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Rows and flagged rows per combination of the keys."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("copies"), count_where(F.col(flag)).alias("flagged")
    )


def repeat_totals(groups: DataFrame) -> DataFrame:
    """The repeat profile next to the flagged rows, one row, of counted groups."""
    repeated = F.col("copies") > 1

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return groups.agg(
        count_where(repeated).alias("duplicate_groups"),
        total(F.when(repeated, F.col("copies") - 1)).alias("excess_duplicate_rows"),
        total(F.when(repeated, F.col("copies"))).alias("rows_in_duplicate_groups"),
        total(F.col("flagged")).alias("flagged_rows"),
    )


def _named(groups: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    return groups.select(
        *[F.col(key).alias(f"{mark}_{key}") for key in keys], F.lit(True).alias(mark)
    )


def _matches(df: DataFrame, groups: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    # NULL keys form groups too, as they do in GROUP BY.
    same = [F.col(key).eqNullSafe(F.col(f"{mark}_{key}")) for key in keys]
    return df.join(groups, reduce(lambda a, b: a & b, same), "left")
