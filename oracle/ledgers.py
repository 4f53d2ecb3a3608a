"""The test tables seen as ledgers and customers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.contracts import (
    BIGINT,
    DATE,
    DOUBLE,
    INTEGER,
    MONEY,
    TEXT,
    LedgerColumns,
    RangeRule,
    RecencyWindows,
    SourceContract,
)

ORDER_WINDOWS = RecencyWindows(date(2001, 8, 1))
SHIPMENT_WINDOWS = RecencyWindows(date(2001, 11, 4))
EVENT_WINDOWS = RecencyWindows(date(2024, 1, 30), 7, (2, 5, 8))
OBSERVED = (date(1996, 1, 1), date(2000, 12, 31))
# Shipments and events repeat on day and kind; their amounts practically never agree.
DAY_AND_KIND = LedgerColumns(repeat_keys=("customer_id", "transaction_date", "transaction_type"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_ledger(df: DataFrame, customer: str, moment: str, amount: str, kind: str) -> DataFrame:
    return df.select(
        F.col(customer).alias("customer_id"),
        F.to_date(moment).alias("transaction_date"),
        F.col(amount).cast("decimal(20,2)").alias("amount_cop"),
        F.col(kind).alias("transaction_type"),
    )


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return as_ledger(df, "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")


def shipments_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return as_ledger(df, "l_partkey", "l_shipdate", "l_extendedprice", "l_returnflag")


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ledger(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_type")


def coarse_events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with amounts in steps of 50, so that some agree in all repeat keys."""
    events = table(spark, sf_dir, "events").withColumn("step", F.floor(F.col("value") / 50) * 50)
    return as_ledger(events, "user_id", "ts", "step", "event_type")


def event_users(spark: SparkSession, sf_dir: str) -> dict:
    """Arguments telling who is eligible among the users of events."""
    return {
        "customers": table(spark, sf_dir, "customer"),
        "customer_key": "c_custkey",
        "eligible": F.col("c_acctbal") > 0,
    }


def order_customers(spark: SparkSession, sf_dir: str) -> dict:
    """Arguments telling who is eligible among those who order."""
    return {
        "customers": table(spark, sf_dir, "customer"),
        "customer_key": "c_custkey",
        "eligible": F.col("c_acctbal") > 0,
    }


def shipped_parts(spark: SparkSession, sf_dir: str) -> dict:
    """Arguments telling which parts are eligible among those shipped."""
    return {
        "customers": table(spark, sf_dir, "part"),
        "customer_key": "p_partkey",
        "eligible": F.col("p_size") <= 40,
        "columns": DAY_AND_KIND,
    }


# Raw text with faults, made from the tables by rules on their values.

RAW_LEDGER = SourceContract(
    key="transactions",
    filename="transactions_data.csv",
    id_column="customer_id",
    day_column="date",
    amount_column="amount",
    kind_column="type",
    repeat_columns=("customer_id", "date", "amount", "type"),
    types={"customer_id": BIGINT, "date": DATE, "amount": MONEY, "type": TEXT},
    categories={"type": ("F", "O")},
)

RAW_CUSTOMERS = SourceContract(
    key="customers",
    filename="customer_data.csv",
    id_column="customer_id",
    flag_column="has_credit",
    types={
        "customer_id": BIGINT,
        "name": TEXT,
        "nation": INTEGER,
        "balance": DOUBLE,
        "segment": TEXT,
        "has_credit": TEXT,
        "tx_count": BIGINT,
        "total_volume": MONEY,
        "first_tx": DATE,
        "last_tx": DATE,
    },
    categories={
        "segment": ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
        "has_credit": ("False", "True"),
    },
    ranges=(
        RangeRule("nation_outside_range", "nation", 0, 20),
        RangeRule("negative_balance", "balance", low=0),
        RangeRule("balance_above_limit", "balance", high=9000),
    ),
    summaries={
        "tx_count": "count",
        "total_volume": "total",
        "first_tx": "first",
        "last_tx": "last",
    },
)


def clean_ledger_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text columns, without faults."""
    return orders_ledger(spark, sf_dir).select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("transaction_date").cast("string").alias("date"),
        F.col("amount_cop").cast("string").alias("amount"),
        F.col("transaction_type").alias("type"),
    )


def faulty_ledger_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text with missing, padded and unparseable values by priority."""
    orders = table(spark, sf_dir, "orders")
    urgent, high, low = (
        F.col("o_orderpriority") == name for name in ("1-URGENT", "2-HIGH", "5-LOW")
    )
    status = F.col("o_orderstatus")
    key = F.col("o_custkey").cast("string")
    day = F.to_date("o_orderdate").cast("string")
    amount = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    return orders.select(
        F.when(urgent & (status == "P"), F.concat(F.lit("C-"), key)).otherwise(key).alias(
            "customer_id"
        ),
        F.when(high & (status == "P"), F.replace(day, F.lit("-"), F.lit("/")))
        .when(high & (status == "O"), F.lit("  "))
        .otherwise(day)
        .alias("date"),
        F.when(urgent & (status == "F"), F.lit(""))
        .when(low & (status == "F"), F.concat(F.lit("USD "), amount))
        .when(low & (status == "O"), F.concat(F.lit("-"), amount))
        .otherwise(amount)
        .alias("amount"),
        F.when(low, F.concat(F.lit(" "), status, F.lit(" "))).otherwise(status).alias("type"),
    )


def customer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as text with summary columns of their orders, some of them wrong.

    Customers with a very high balance have lost their id; those deep in debt
    are listed twice.
    """
    customers = table(spark, sf_dir, "customer")
    per_customer = (
        orders_ledger(spark, sf_dir)
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("amount_cop").cast("decimal(20,2)").alias("total"),
            F.min("transaction_date").alias("first"),
            F.max("transaction_date").alias("last"),
        )
    )
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    listed = customers.join(
        per_customer, F.col("c_custkey") == F.col("customer_id"), "left"
    ).select(
        F.when(balance <= 9900, F.col("c_custkey").cast("string")).alias("customer_id"),
        F.col("c_name").alias("name"),
        F.when(segment == "HOUSEHOLD", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
        .otherwise(F.col("c_nationkey").cast("string"))
        .alias("nation"),
        F.col("c_acctbal").cast("string").alias("balance"),
        segment.alias("segment"),
        F.when(balance > 0, "True").when(balance > -900, "False").otherwise("").alias("has_credit"),
        F.col("n").cast("string").alias("tx_count"),
        F.when(segment == "MACHINERY", F.col("total") + 1)
        .otherwise(F.col("total"))
        .cast("decimal(20,2)")
        .cast("string")
        .alias("total_volume"),
        F.col("first").cast("string").alias("first_tx"),
        F.when(segment == "BUILDING", F.date_add("last", 1))
        .otherwise(F.col("last"))
        .cast("string")
        .alias("last_tx"),
    )
    return listed.unionByName(listed.filter(F.col("balance").cast("double") < -900))
