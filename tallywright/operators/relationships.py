"""How the ledger and the customers fit together.

The ledger is reduced to one row per customer id once, with partial aggregation,
and everything else works on that.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONCENTRATION_LIMIT = 10


def ledger_per_customer(
    ledger: DataFrame, customer: Column, day: Column, amount: Column
) -> DataFrame:
    """Count, total, first and last day per customer id."""
    return ledger.groupBy(customer.alias("customer_id")).agg(
        F.count("*").alias("ledger_count"),
        F.sum(amount.cast("decimal(38,2)")).alias("ledger_total"),
        F.min(day).alias("ledger_first"),
        F.max(day).alias("ledger_last"),
    )


def rows_per_customer(ledger: DataFrame, customer: Column) -> DataFrame:
    """Count per customer id, where nothing else is needed."""
    return ledger.groupBy(customer.alias("customer_id")).agg(F.count("*").alias("ledger_count"))


def orphans(per_customer: DataFrame, customers: DataFrame, key: Column) -> DataFrame:
    """Ledger rows and ids without a customer, one row; NULL ids are orphans."""
    known = customers.select(key.alias("customer_id")).distinct()
    return per_customer.join(known, "customer_id", "left_anti").agg(
        F.coalesce(F.sum("ledger_count"), F.lit(0)).alias("orphan_rows"),
        F.count("customer_id").alias("orphan_ids"),
    )


def childless(customers: DataFrame, key: Column, per_customer: DataFrame) -> DataFrame:
    """Customers without ledger rows, one row."""
    listed = customers.groupBy(key.alias("customer_id")).agg(F.count("*").alias("n"))
    return listed.join(per_customer.select("customer_id"), "customer_id", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("customers_without_rows")
    )


def count_distribution(per_customer: DataFrame) -> DataFrame:
    """Distribution of ledger rows per customer, one row.

    Customers are first counted per row count, so the exact quantiles work on a
    short weighted list however many customers there are.
    """
    counts = per_customer.groupBy(F.col("ledger_count").alias("n")).agg(
        F.count("*").alias("customers")
    )
    rows = F.sum(F.col("n") * F.col("customers"))
    return counts.agg(
        F.coalesce(F.sum("customers"), F.lit(0)).alias("customers_with_rows"),
        F.min("n").alias("minimum"),
        F.round(rows / F.sum("customers"), 4).alias("mean"),
        F.round(F.percentile("n", F.lit(0.5), F.col("customers")), 2).alias("median"),
        F.round(F.percentile("n", F.lit(0.95), F.col("customers")), 2).alias("p95"),
        F.max("n").alias("maximum"),
    )


def concentration(distribution: DataFrame, limit: float = CONCENTRATION_LIMIT) -> DataFrame:
    """Largest customer against the 95th percentile, from the distribution."""
    ratio = F.round(F.col("maximum") / F.nullif(F.col("p95"), F.lit(0.0)), 2)
    return distribution.select(
        "*",
        ratio.alias("maximum_to_p95_ratio"),
        F.coalesce(ratio > limit, F.lit(False)).alias("concentrated"),
    )


def reconcile(
    customers: DataFrame,
    key: Column,
    per_customer: DataFrame,
    summaries: Mapping[str, tuple[Column, str]],
) -> DataFrame:
    """Customers whose summary columns disagree with the ledger, one row.

    ``summaries`` maps a name to the summary column and the ledger measure it
    repeats: count, total, first or last.
    """
    claimed = {f"claimed_{name}": column for name, (column, _) in summaries.items()}
    # Customers listed many times with the same values are one row from here on.
    listed = customers.groupBy(
        key.alias("customer_id"), *[column.alias(name) for name, column in claimed.items()]
    ).agg(F.count("*").alias("n"))
    compared = listed.join(per_customer, "customer_id")
    counts = [F.coalesce(F.sum("n"), F.lit(0)).alias("customers_compared")]
    for name, (_, measure) in summaries.items():
        differs = ~F.col(f"claimed_{name}").eqNullSafe(F.col(f"ledger_{measure}"))
        found = F.coalesce(F.sum(F.when(differs, F.col("n"))), F.lit(0))
        counts.append(found.alias(f"{name}_mismatches"))
    return compared.agg(*counts)
