"""Profiles of raw text tables: missing, unparseable, unexpected, out of range.

Everything that can be counted row by row is counted in one aggregation per
table; ``null_profile``, ``parse_profile`` and ``range_profile`` show parts of
the same row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.contracts import RangeRule, SourceContract
from tallywright.functions.frames import literal_rows, turn_to_rows
from tallywright.functions.numbers import count_where
from tallywright.functions.text import (
    NULL_LABEL,
    lenient_table,
    normalise_table,
    null_label,
    typed_name,
)


def null_counts(columns: Sequence[str]) -> dict[str, Column]:
    """Aggregates over normalised text counting missing values per column."""
    return {name: F.expr(f"count(*) - count(`{name}`)") for name in columns}


def parse_failures(types: Mapping[str, T.DataType]) -> dict[str, Column]:
    """Aggregates over a lenient table counting unparseable values per typed column."""
    return {
        name: F.expr(f"count(`{name}`) - count(`{typed_name(name)}`)")
        for name, kind in types.items()
        if not isinstance(kind, T.StringType)
    }


def range_violations(rules: Sequence[RangeRule]) -> dict[str, Column]:
    """Aggregates over a lenient table counting values out of range; NULL breaks no rule."""
    counted = {}
    for rule in rules:
        value = F.col(typed_name(rule.column))
        low = F.lit(False) if rule.low is None else value < rule.low
        high = F.lit(False) if rule.high is None else value > rule.high
        counted[rule.name] = count_where(low | high)
    return counted


def null_profile(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing or empty values per column."""
    table = normalise_table(raw, columns)
    return _measure(table, null_counts(columns), "column_name", "null_count")


def parse_profile(raw: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Values that do not parse, per typed column."""
    table = lenient_table(raw, types)
    return _measure(table, parse_failures(types), "column_name", "parse_failures")


def range_profile(
    raw: DataFrame, rules: Sequence[RangeRule], types: Mapping[str, T.DataType]
) -> DataFrame:
    """Values out of range, per rule."""
    table = lenient_table(raw, {rule.column: types[rule.column] for rule in rules})
    return _measure(table, range_violations(rules), "rule", "violations")


def category_profile(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each categorical column, all columns in one pass."""
    pairs = [
        F.struct(F.lit(name).alias("column_name"), null_label(name).alias("value"))
        for name in columns
    ]
    return (
        raw.select(F.inline(F.array(*pairs)))
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("row_count"))
    )


def unexpected_categories(
    frequencies: DataFrame, allowed: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Values of the category profile that no allow-list names; NULL is allowed."""
    listed = literal_rows(
        frequencies.sparkSession,
        [
            {"column_name": name, "value": value}
            for name, values in allowed.items()
            for value in (*values, NULL_LABEL)
        ],
    )
    return frequencies.join(F.broadcast(listed), ["column_name", "value"], "left_anti")


def unexpected_summary(unexpected: DataFrame) -> DataFrame:
    """Unexpected values and their rows as a map by column, one row.

    The values themselves stay in the profile: there may be any number of them.
    """
    per_column = unexpected.groupBy("column_name").agg(
        F.count("*").alias("values"), F.sum("row_count").alias("rows")
    )
    entry = F.struct("column_name", F.struct("rows", "values").alias("found"))
    return per_column.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("unexpected_rows"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("unexpected_by_column"),
    )


def flag_holders(frequencies: DataFrame, column: str, holds: str = "True") -> DataFrame:
    """Rows whose flag is set, from the category profile, one row."""
    held = (F.col("column_name") == column) & (F.col("value") == holds)
    return frequencies.filter(held).agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("flag_holders")
    )


def key_profile(raw: DataFrame, column: str, data_type: T.DataType) -> DataFrame:
    """Rows, missing ids, distinct ids and repeated id rows, one row.

    An id that does not parse is not distinct from anything, so it counts as a
    repeated row; the parse profile tells how many of those there are.
    """
    table = lenient_table(raw, {column: data_type})
    # One row per id first: the id that fills the table is one row from then on.
    return (
        table.groupBy(F.col(typed_name(column)).alias("id"))
        .agg(F.count("*").alias("n"), null_counts([column])[column].alias("empty"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum("empty"), F.lit(0)).alias("null_ids"),
            F.count("id").alias("distinct_ids"),
        )
        .withColumn(
            "duplicate_id_rows", F.col("row_count") - F.col("null_ids") - F.col("distinct_ids")
        )
    )


def ledger_measures(
    day: Column, amount: Column, observed: tuple[date, date]
) -> dict[str, Column]:
    """Aggregates describing the dates and amounts of a ledger."""
    outside = ~day.between(F.lit(observed[0]), F.lit(observed[1]))
    return {
        "row_count": F.count("*"),
        "minimum_date": F.min(day),
        "maximum_date": F.max(day),
        "minimum_amount": F.min(amount),
        "maximum_amount": F.max(amount),
        "total_amount": F.sum(amount.cast("decimal(38,2)")),
        "zero_amount_rows": count_where(amount == 0),
        "negative_amount_rows": count_where(amount < 0),
        "dates_outside_observation_window": count_where(outside),
    }


def ledger_profile(
    ledger: DataFrame, day: Column, amount: Column, observed: tuple[date, date]
) -> DataFrame:
    """Row count, date range, amount range and total of a ledger, one row."""
    measures = ledger_measures(day, amount, observed)
    return ledger.agg(*[value.alias(name) for name, value in measures.items()])


def source_measures(contract: SourceContract) -> list[Column]:
    """All row-by-row counts of one source as aggregates over its lenient table."""
    kinds = {
        "nulls": null_counts(contract.columns),
        "parse_failures": parse_failures(contract.types),
        "ranges": range_violations(contract.ranges),
    }
    structs = [
        F.struct(*[value.alias(name) for name, value in counts.items()]).alias(kind)
        for kind, counts in kinds.items()
        if counts
    ]
    return [F.count("*").alias("row_count"), *structs]


def required_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per required column of a typed table."""
    counts = {name: count_where(F.col(name).isNull()) for name in columns}
    return _measure(df, counts, "column_name", "null_count")


def flagged_rows(df: DataFrame, flag: str) -> DataFrame:
    """Rows with the flag set, one row."""
    return df.agg(count_where(F.col(flag)).alias("flagged_rows"))


def _measure(
    df: DataFrame, aggregates: Mapping[str, Column], name: str, value: str
) -> DataFrame:
    measured = df.agg(*[column.alias(key) for key, column in aggregates.items()])
    return turn_to_rows(measured, {key: F.col(key) for key in aggregates}, name, value)
