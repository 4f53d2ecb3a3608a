"""One query per operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle import ledgers as L
from tallywright.functions.text import lenient_table, typed_name
from tallywright.operators import (
    engagement,
    profile,
    ranks,
    recency,
    relationships,
    repeats,
    rowkey,
    summaries,
)
from tallywright.operators.checks import check_frame, status_counts
from tallywright.operators.fingerprint import fingerprint
from tallywright.plans.analysis import run_analysis
from tallywright.plans.build import build
from tallywright.plans.health import inspect_health
from tallywright.plans.preflight import check_contents
from tallywright.sources import identity, raw_text
from tallywright.sources.reports import json_ready, two_decimals
from tallywright.sources.scratch import scratch_path, stage
from tallywright.sources.versions import published_version, read_published

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- working relations ---------------------------------------------------------


@query
def recency_canonical(spark, sf_dir):
    ledger = L.orders_ledger(spark, sf_dir)
    return recency.working_relation(
        ledger, windows=L.ORDER_WINDOWS, **L.order_customers(spark, sf_dir)
    )


@query
def recency_collapsed(spark, sf_dir):
    ledger = L.shipments_ledger(spark, sf_dir)
    return recency.collapsed_working_relation(
        ledger, windows=L.SHIPMENT_WINDOWS, **L.shipped_parts(spark, sf_dir)
    )


@query
def recency_shipments(spark, sf_dir):
    ledger = L.shipments_ledger(spark, sf_dir)
    return recency.working_relation(
        ledger, windows=L.SHIPMENT_WINDOWS, **L.shipped_parts(spark, sf_dir)
    )


def shipment_pair(spark, sf_dir):
    ledger = L.shipments_ledger(spark, sf_dir)
    return recency.working_relation_pair(
        ledger, windows=L.SHIPMENT_WINDOWS, **L.shipped_parts(spark, sf_dir)
    )


@query
def recency_pair(spark, sf_dir):
    return recency.stack_pair(shipment_pair(spark, sf_dir))


@query
def distinct_events(spark, sf_dir):
    return recency.distinct_events(L.events_ledger(spark, sf_dir), L.DAY_AND_KIND)


@query
def recency_contract(spark, sf_dir):
    working = recency_canonical(spark, sf_dir)
    return recency.contract_violations(
        working,
        L.ORDER_WINDOWS,
        expected_population=1000,
        expected_scenario_counts={30: 900, 60: 800, 90: 700},
    )


@query
def variant_grain_diff(spark, sf_dir):
    # Late orders dropped from one side: some customers vanish, others look older.
    ledger = L.orders_ledger(spark, sf_dir)
    arguments = {"windows": L.ORDER_WINDOWS, **L.order_customers(spark, sf_dir)}
    earlier = ledger.filter(F.col("transaction_type") != "P")
    return recency.grain_difference(
        recency.working_relation(ledger, **arguments),
        recency.working_relation(earlier, **arguments),
    )


# -- summaries -----------------------------------------------------------------


@query
def scenario_summary(spark, sf_dir):
    variants = recency.stack_pair(shipment_pair(spark, sf_dir))
    return summaries.scenario_summary(variants, L.SHIPMENT_WINDOWS)


@query
def scenario_change(spark, sf_dir):
    summary = scenario_summary(spark, sf_dir)
    return summaries.order_scenarios(summaries.scenario_change(summary, L.SHIPMENT_WINDOWS))


@query
def scenario_table_text(spark, sf_dir):
    return two_decimals(scenario_change(spark, sf_dir))


@query
def band_summary(spark, sf_dir):
    return summaries.band_summary(recency_shipments(spark, sf_dir), L.SHIPMENT_WINDOWS)


@query
def recency_stats(spark, sf_dir):
    return summaries.recency_statistics(recency_canonical(spark, sf_dir))


@query
def recency_ecdf(spark, sf_dir):
    return summaries.recency_ecdf(recency_canonical(spark, sf_dir))


@query
def trajectory_stats(spark, sf_dir):
    return summaries.trajectory_statistics(recency_shipments(spark, sf_dir), L.SHIPMENT_WINDOWS)


@query
def activity_grid(spark, sf_dir):
    return summaries.activity_grid(recency_shipments(spark, sf_dir), L.SHIPMENT_WINDOWS)


@query
def population_summary(spark, sf_dir):
    return summaries.population_summary(recency_canonical(spark, sf_dir))


@query
def repeat_sensitivity(spark, sf_dir):
    return summaries.sensitivity_statistics(shipment_pair(spark, sf_dir), L.SHIPMENT_WINDOWS)


@query
def repeat_sensitivity_merged(spark, sf_dir):
    pair = summaries.pair_variants(
        recency_shipments(spark, sf_dir), recency_collapsed(spark, sf_dir)
    )
    return summaries.sensitivity_statistics(pair, L.SHIPMENT_WINDOWS)


@query
def analysis_scenarios(spark, sf_dir):
    arguments = L.shipped_parts(spark, sf_dir)
    ledger = L.shipments_ledger(spark, sf_dir)
    analysis = run_analysis(
        ledger,
        arguments["customers"],
        L.SHIPMENT_WINDOWS,
        eligible=arguments["eligible"],
        columns=arguments["columns"],
        customer_key=arguments["customer_key"],
    )
    return analysis.summaries["scenarios"]


@query
def scenario_change_percent(spark, sf_dir):
    change = summaries.scenario_change(scenario_summary(spark, sf_dir), L.SHIPMENT_WINDOWS)
    return summaries.scenario_relative_change(change, L.SHIPMENT_WINDOWS)


@query
def activity_hexagons(spark, sf_dir):
    return summaries.activity_hexagons(recency_shipments(spark, sf_dir), L.SHIPMENT_WINDOWS)


# -- engagement ------------------------------------------------------------------


@query
def recency_windows(spark, sf_dir):
    return engagement.recency_windows(
        L.orders_ledger(spark, sf_dir),
        analysis_date=L.ORDER_WINDOWS.analysis_date,
        **L.order_customers(spark, sf_dir),
    )


@query
def value_measures(spark, sf_dir):
    return engagement.value_measures(
        L.coarse_events_ledger(spark, sf_dir),
        windows=L.EVENT_WINDOWS,
        **L.event_users(spark, sf_dir),
    )


@query
def transaction_mix(spark, sf_dir):
    return engagement.transaction_mix(
        L.orders_ledger(spark, sf_dir), kinds=("F", "O"), **L.order_customers(spark, sf_dir)
    )


@query
def transaction_mix_events(spark, sf_dir):
    return engagement.transaction_mix(
        L.events_ledger(spark, sf_dir),
        kinds=("purchase", "signup", "click"),
        **L.event_users(spark, sf_dir),
    )


@query
def engagement_segments(spark, sf_dir):
    pair = recency.working_relation_pair(
        L.orders_ledger(spark, sf_dir),
        windows=L.ORDER_WINDOWS,
        values=True,
        **L.order_customers(spark, sf_dir),
    )
    return engagement.engagement_segments(recency.split_pair(pair)[0])


@query
def segment_summary(spark, sf_dir):
    return engagement.segment_summary(engagement_segments(spark, sf_dir))


@query
def segment_profile(spark, sf_dir):
    return engagement.segment_profile(
        engagement_segments(spark, sf_dir),
        L.table(spark, sf_dir, "customer"),
        {"market": F.col("c_mktsegment"), "nation": F.col("c_nationkey")},
        customer_key="c_custkey",
    )


@query
def amount_quantiles(spark, sf_dir):
    shares = (0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
    return ranks.quantile_table(L.shipments_ledger(spark, sf_dir), "amount_cop", shares)


# -- profiles ------------------------------------------------------------------


@query
def null_profile(spark, sf_dir):
    raw = L.faulty_ledger_text(spark, sf_dir)
    return profile.null_profile(raw, L.RAW_LEDGER.columns)


@query
def parse_profile(spark, sf_dir):
    return profile.parse_profile(L.faulty_ledger_text(spark, sf_dir), L.RAW_LEDGER.types)


@query
def customer_parse_profile(spark, sf_dir):
    return profile.parse_profile(L.customer_text(spark, sf_dir), L.RAW_CUSTOMERS.types)


@query
def category_profile(spark, sf_dir):
    raw = L.customer_text(spark, sf_dir)
    return profile.category_profile(raw, list(L.RAW_CUSTOMERS.categories))


@query
def unexpected_categories(spark, sf_dir):
    return profile.unexpected_categories(
        category_profile(spark, sf_dir), L.RAW_CUSTOMERS.categories
    )


@query
def flag_holders(spark, sf_dir):
    return profile.flag_holders(category_profile(spark, sf_dir), "has_credit")


@query
def event_categories(spark, sf_dir):
    raw = L.table(spark, sf_dir, "events")
    return profile.category_profile(raw, ["event_type", "props"])


@query
def key_profile(spark, sf_dir):
    raw = L.customer_text(spark, sf_dir)
    return profile.key_profile(raw, "customer_id", L.RAW_CUSTOMERS.types["customer_id"])


@query
def range_profile(spark, sf_dir):
    raw = L.customer_text(spark, sf_dir)
    return profile.range_profile(raw, L.RAW_CUSTOMERS.ranges, L.RAW_CUSTOMERS.types)


def lenient_orders(spark, sf_dir):
    table = lenient_table(L.faulty_ledger_text(spark, sf_dir), L.RAW_LEDGER.types)
    return table.select(
        F.col(typed_name("customer_id")).alias("customer_id"),
        F.col(typed_name("date")).alias("transaction_date"),
        F.col(typed_name("amount")).alias("amount_cop"),
        F.col("type").alias("transaction_type"),
    )


@query
def lenient_cast(spark, sf_dir):
    return lenient_orders(spark, sf_dir)


@query
def required_nulls(spark, sf_dir):
    columns = ["customer_id", "transaction_date", "amount_cop", "transaction_type"]
    return profile.required_nulls(lenient_orders(spark, sf_dir), columns)


@query
def ledger_profile(spark, sf_dir):
    ledger = lenient_orders(spark, sf_dir)
    return profile.ledger_profile(
        ledger, F.col("transaction_date"), F.col("amount_cop"), L.OBSERVED
    )


# -- relationships -------------------------------------------------------------


def order_counts(spark, sf_dir):
    return relationships.rows_per_customer(
        L.orders_ledger(spark, sf_dir), F.col("customer_id")
    )


@query
def ledger_per_customer(spark, sf_dir):
    return relationships.ledger_per_customer(
        L.orders_ledger(spark, sf_dir),
        F.col("customer_id"),
        F.col("transaction_date"),
        F.col("amount_cop"),
    )


@query
def orphans(spark, sf_dir):
    # Orders of customers in debt, had those customers been left out.
    customers = L.table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return relationships.orphans(order_counts(spark, sf_dir), customers, F.col("c_custkey"))


@query
def childless(spark, sf_dir):
    customers = L.table(spark, sf_dir, "customer")
    users = relationships.rows_per_customer(
        L.events_ledger(spark, sf_dir), F.col("customer_id")
    )
    return relationships.childless(customers, F.col("c_custkey"), users)


@query
def count_distribution(spark, sf_dir):
    return relationships.count_distribution(order_counts(spark, sf_dir))


@query
def concentration(spark, sf_dir):
    distribution = count_distribution(spark, sf_dir)
    return relationships.concentration(distribution, 1.5).select(
        "maximum", "p95", "maximum_to_p95_ratio", "concentrated"
    )


@query
def reconcile(spark, sf_dir):
    raw = L.customer_text(spark, sf_dir)
    typed = lenient_table(raw, L.RAW_CUSTOMERS.types)
    claims = {
        name: (F.col(typed_name(name)), measure)
        for name, measure in L.RAW_CUSTOMERS.summaries.items()
    }
    return relationships.reconcile(
        typed, F.col(typed_name("customer_id")), ledger_per_customer(spark, sf_dir), claims
    )


# -- repeats, keys, fingerprints -----------------------------------------------


@query
def repeat_groups(spark, sf_dir):
    ledger = L.events_ledger(spark, sf_dir)
    return repeats.repeat_profile(ledger, L.DAY_AND_KIND.repeat_keys)


@query
def repeat_flag(spark, sf_dir):
    return repeats.flag_repeats(
        L.events_ledger(spark, sf_dir), L.DAY_AND_KIND.repeat_keys, "is_duplicate_looking"
    )


@query
def repeat_flag_long_list(spark, sf_dir):
    # The same through the path for lists of groups that are too long to broadcast.
    return repeats.flag_repeats(
        L.shipments_ledger(spark, sf_dir),
        L.DAY_AND_KIND.repeat_keys,
        "is_duplicate_looking",
        broadcast_groups=10,
    )


@query
def flag_integrity(spark, sf_dir):
    return repeats.flag_integrity(
        repeat_flag(spark, sf_dir), L.DAY_AND_KIND.repeat_keys, "is_duplicate_looking"
    )


@query
def flagged_rows(spark, sf_dir):
    return profile.flagged_rows(repeat_flag(spark, sf_dir), "is_duplicate_looking")


@query
def sequential_key(spark, sf_dir):
    orders = L.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rowkey.sequential_key(orders, "transaction_row_id")


@query
def sequential_key_by(spark, sf_dir):
    shipments = L.table(spark, sf_dir, "lineitem").select(
        "l_shipdate", "l_partkey", "l_orderkey", "l_linenumber"
    )
    order = ["l_shipdate", "l_partkey", "l_orderkey", "l_linenumber"]
    return rowkey.sequential_key_by(shipments, order, "transaction_row_id")


@query
def row_key_integrity(spark, sf_dir):
    return rowkey.row_key_integrity(L.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query
def fingerprint_orders(spark, sf_dir):
    return fingerprint(L.orders_ledger(spark, sf_dir))


@query
def fingerprint_customers(spark, sf_dir):
    return fingerprint(L.customer_text(spark, sf_dir))


# -- checks, reports and whole runs --------------------------------------------


@query
def check_report(spark, sf_dir):
    checks, _ = check_contents(
        stage(L.customer_text(spark, sf_dir), "customers"),
        stage(L.faulty_ledger_text(spark, sf_dir), "transactions"),
        customers=L.RAW_CUSTOMERS,
        ledger=L.RAW_LEDGER,
        observed=L.OBSERVED,
    )
    return check_frame(spark, checks).select("check_ordinal", "check_code", "status")


@query
def check_status_counts(spark, sf_dir):
    return status_counts(check_report(spark, sf_dir))


@query
def report_values(spark, sf_dir):
    return json_ready(ledger_profile(spark, sf_dir))


def write_raw_files(spark: SparkSession, sf_dir: str, files: int | None = None) -> str:
    """Orders and their customers as CSV in a new folder, each in at most so many files."""

    def written(df: DataFrame, name: str) -> None:
        (df.coalesce(files) if files else df).write.csv(f"{directory}/{name}", header=True)

    directory = scratch_path(spark, "raw")
    ordered = L.table(spark, sf_dir, "orders").orderBy("o_orderkey")
    ledger = L.as_ledger(ordered, "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    ledger = ledger.select(
        "customer_id",
        F.col("transaction_date").alias("date"),
        F.col("amount_cop").alias("amount"),
        F.col("transaction_type").alias("type"),
    )
    written(ledger, L.RAW_LEDGER.filename)
    customers = L.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    written(customers, PLAIN_CUSTOMERS.filename)
    return directory


PLAIN_CUSTOMERS = replace(
    L.RAW_CUSTOMERS,
    types={
        name: L.RAW_CUSTOMERS.types[name]
        for name in ("customer_id", "name", "nation", "balance", "segment")
    },
    categories={"segment": L.RAW_CUSTOMERS.categories["segment"]},
    summaries={},
    flag_column=None,
)
CONTRACTS = [PLAIN_CUSTOMERS, L.RAW_LEDGER]


@query
def text_scan(spark, sf_dir):
    directory = write_raw_files(spark, sf_dir)
    return raw_text.read_text_table(spark, L.RAW_LEDGER, directory).drop(raw_text.CORRUPT)


@query
def manifest(spark, sf_dir):
    files = raw_text.file_manifest(spark, write_raw_files(spark, sf_dir), CONTRACTS)
    return raw_text.source_manifest(files, CONTRACTS).select(
        "source_key", "source_filename", "data_rows", F.expr("files > 0").alias("present")
    )


@query
def source_identity(spark, sf_dir):
    # One file a source, so that there is one header.
    directory = write_raw_files(spark, sf_dir, files=1)
    return identity.source_identity(spark, directory, CONTRACTS)


@query
def header_contract(spark, sf_dir):
    # Held against a contract with one more column, in another order.
    directory = write_raw_files(spark, sf_dir)
    wanted = replace(L.RAW_LEDGER, types={"note": L.TEXT, **L.RAW_LEDGER.types})
    files = raw_text.file_manifest(spark, directory, [wanted])
    found = raw_text.header_contract(files, [wanted])
    return found.select(
        "source_key",
        "expected_columns",
        "observed_columns",
        F.concat_ws(",", "missing_columns").alias("missing_columns"),
        F.concat_ws(",", "unexpected_columns").alias("unexpected_columns"),
        "order_matches",
    ).distinct()


@query
def scanned_counts(spark, sf_dir):
    directory = write_raw_files(spark, sf_dir)
    tables = [(c, raw_text.stage_text_table(spark, c, directory)) for c in CONTRACTS]
    files = raw_text.file_manifest(spark, directory, CONTRACTS)
    return raw_text.scanned_counts(tables, raw_text.source_manifest(files, CONTRACTS))


def published(spark: SparkSession, sf_dir: str) -> str:
    target = scratch_path(spark, "published")
    build(
        spark,
        write_raw_files(spark, sf_dir),
        target,
        customers=PLAIN_CUSTOMERS,
        ledger=L.RAW_LEDGER,
        observed=L.OBSERVED,
    )
    return target


@query
def published_ledger(spark, sf_dir):
    return read_published(spark, published(spark, sf_dir))[1]


@query
def published_customers(spark, sf_dir):
    return read_published(spark, published(spark, sf_dir))[0]


@query
def build_audit(spark, sf_dir):
    # Without ids, times, versions and what depends on how files were written.
    version = published_version(spark, published(spark, sf_dir))
    return spark.read.parquet(version.build_info).select(
        "source_key",
        "source_filename",
        "source_row_count",
        "loaded_table",
        "loaded_row_count",
        "minimum_date",
        "maximum_date",
    )


@query
def stored_checks(spark, sf_dir):
    # The checks of the load as they were stored, metrics included.
    version = published_version(spark, published(spark, sf_dir))
    stored = spark.read.parquet(version.validation_results)
    return stored.where("check_code like 'database.%'").select("check_code", "status", "metrics")


@query
def persisted_failures(spark, sf_dir):
    # Faults of the raw tables as a build would have stored them, without those that passed.
    return check_report(spark, sf_dir).where(F.col("status") != "pass")


@query
def published_health(spark, sf_dir):
    health = inspect_health(
        spark, published(spark, sf_dir), customers=PLAIN_CUSTOMERS, ledger=L.RAW_LEDGER
    )
    return health.details["logical_fingerprints"].withColumn("failed", F.lit(health.failed))
