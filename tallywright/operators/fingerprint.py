"""Order-independent fingerprints of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.hashing import row_hash


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, xor and sum of the row hashes, one row.

    The result depends on the rows only, not on their order or partitioning.
    """
    chosen = df.select(*columns) if columns else df
    hashed = chosen.select(row_hash(chosen.schema.fields).alias("h"))
    return hashed.agg(
        F.count("*").alias("row_count"),
        F.bit_xor("h").alias("hash_xor"),
        F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"),
    )
