"""Small DataFrames and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(spark: SparkSession, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """A DataFrame of literals, for lists that are part of a contract."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def turn_to_rows(
    measured: DataFrame, values: Mapping[str, Column], name: str, value: str
) -> DataFrame:
    """Columns of a one-row DataFrame as rows of (name, value)."""
    structs = [F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in values.items()]
    return measured.select(F.inline(F.array(*structs)))
