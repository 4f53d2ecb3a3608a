"""Writing summaries and check reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.operators.checks import Check, check_frame, metrics_json, status_counts


def two_decimals(df: DataFrame) -> DataFrame:
    """Floating-point columns as text with two decimals; NULL stays NULL."""
    shown = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.when(column.isNotNull(), F.format_string("%.2f", column))
        shown.append(column.alias(field.name))
    return df.select(*shown)


def write_summary_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Write a summary of a few rows as one ordered CSV file with a header."""
    one_file = df.repartition(1).sortWithinPartitions(*order)
    two_decimals(one_file).write.csv(path, header=True, emptyValue="", nullValue="")


def json_ready(df: DataFrame) -> DataFrame:
    """Columns in name order, decimals and dates as text, so JSON is stable and exact."""
    shown = []
    for field in sorted(df.schema.fields, key=lambda field: field.name):
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DecimalType, T.DateType, T.TimestampType)):
            column = column.cast("string")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def write_report(
    spark: SparkSession,
    path: str,
    checks: Sequence[Check],
    measures: Mapping[str, object],
    profiles: Mapping[str, DataFrame],
) -> None:
    """Write a report: checks, status counts and measures as one JSON document.

    Profiles may have any number of rows. Each goes to a folder of its own,
    written where it is computed; none passes through the driver.
    """
    counts = status_counts(check_frame(spark, checks)).collect()
    document = {
        "summary": {row["status"]: row["checks"] for row in counts},
        "measures": measures,
        "checks": [asdict(found) for found in checks],
    }
    text = spark.createDataFrame([(metrics_json(document),)], "report string")
    text.coalesce(1).write.text(f"{path}/report")
    for name, part in profiles.items():
        json_ready(part).write.option("ignoreNullFields", False).json(f"{path}/{name}")
