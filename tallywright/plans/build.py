"""Typed load of a pair of raw sources, checked before it is published."""

from __future__ import annotations

import platform
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, date, datetime
from functools import reduce
from uuid import uuid4

import pyspark
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.contracts import (
    BANK_OBSERVED,
    CUSTOMERS,
    TRANSACTIONS,
    LedgerColumns,
    SourceContract,
)
from tallywright.functions.numbers import count_where
from tallywright.operators import relationships
from tallywright.operators.checks import (
    CHECK_SCHEMA,
    WARNING,
    Check,
    check,
    check_frame,
    has_failures,
    measure,
    pick,
)
from tallywright.operators.repeats import repeat_counts, repeat_totals
from tallywright.operators.rowkey import row_key_integrity
from tallywright.plans.preflight import Measures, Preflight, run_preflight
from tallywright.sources.paths import remove
from tallywright.sources.scratch import stage
from tallywright.sources.typed import ledger_schema, typed_columns, typed_ledger
from tallywright.sources.versions import PublishConflict, Version, publish, published_version

BUILD_INFO = T.StructType(
    [
        T.StructField("build_id", T.StringType()),
        T.StructField("built_at_utc", T.TimestampType()),
        T.StructField("source_key", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("dataset_version", T.StringType()),
        T.StructField("dataset_source_url", T.StringType()),
        T.StructField("source_filename", T.StringType()),
        T.StructField("source_fingerprint", T.StringType()),
        T.StructField("source_byte_size", T.LongType()),
        T.StructField("source_row_count", T.LongType()),
        T.StructField("loaded_schema", T.StringType()),
        T.StructField("loaded_table", T.StringType()),
        T.StructField("loaded_row_count", T.LongType()),
        T.StructField("minimum_date", T.DateType()),
        T.StructField("maximum_date", T.DateType()),
        T.StructField("spark_version", T.StringType()),
        T.StructField("python_version", T.StringType()),
    ]
)
VALIDATION_RESULTS = T.StructType(
    [T.StructField("build_id", T.StringType()), *CHECK_SCHEMA.fields]
)
KEY_METRICS = ("null_ids", "duplicate_id_rows", "minimum_id", "maximum_id")
FLAG_METRICS = (
    "duplicate_groups",
    "excess_duplicate_rows",
    "rows_in_duplicate_groups",
    "flagged_rows",
)


class BuildError(RuntimeError):
    """A build that did not complete."""


class ValidationError(BuildError):
    """Sources or loaded tables that break a blocking check."""

    def __init__(self, message: str, checks: Sequence[Check]) -> None:
        super().__init__(message)
        self.checks = list(checks)


@dataclass(frozen=True)
class Dataset:
    """Where the raw sources come from; recorded with every build."""

    name: str = ""
    version: str = ""
    source_url: str = ""


@dataclass(frozen=True)
class Build:
    """A published build."""

    version: Version
    customer_rows: int
    ledger_rows: int
    checks: list[Check]

    @property
    def warnings(self) -> int:
        return sum(found.status == WARNING for found in self.checks)


def build(
    spark: SparkSession,
    directory: str,
    target: str,
    *,
    replace: bool = False,
    customers: SourceContract = CUSTOMERS,
    ledger: SourceContract = TRANSACTIONS,
    columns: LedgerColumns = LedgerColumns(),
    observed: tuple[date, date] = BANK_OBSERVED,
    dataset: Dataset = Dataset(),
) -> Build:
    """Check the sources, load them with types, check the result, publish it.

    The tables go to the folder of a new version. Only the last step makes that
    version visible, so whatever fails before leaves the published one alone.
    """
    before = published_version(spark, target)
    if before is not None and not replace:
        raise BuildError(f"{target} is published already; pass replace=True to publish anew")
    preflight = run_preflight(
        spark, directory, customers=customers, ledger=ledger, observed=observed
    )
    if preflight.failed:
        raise ValidationError("the raw sources break a blocking check", preflight.checks)

    version = Version(target, str(uuid4()))
    try:
        return _build(spark, version, before, preflight, (customers, ledger), columns, dataset)
    except BaseException:
        remove(spark, version.path)  # nothing names it
        raise


def _build(
    spark: SparkSession,
    version: Version,
    before: Version | None,
    preflight: Preflight,
    contracts: tuple[SourceContract, SourceContract],
    columns: LedgerColumns,
    dataset: Dataset,
) -> Build:
    """Load, check and publish a version in place of the one that was published before."""
    customers, ledger = contracts
    try:
        raw = preflight.tables
        typed_columns(raw[customers.key], customers).write.parquet(version.customers)
        typed_ledger(raw[ledger.key], ledger, columns).write.parquet(version.ledger)
    except PySparkException as error:
        problem = check(
            "database.typed_load",
            False,
            "",
            "A value does not fit its declared type.",
            error_type=type(error).__name__,
        )
        raise ValidationError(str(error), [problem]) from error

    schemas = {
        version.customers: customers.typed_schema(),
        version.ledger: ledger_schema(ledger, columns),
    }
    loaded = [spark.read.parquet(path) for path in schemas]
    measured = table_measures(*loaded, customers.id_column, columns)
    checks = [
        *preflight.checks,
        *structure_checks(spark, schemas),
        *post_load_checks(measured, preflight, (customers.key, ledger.key), columns),
    ]
    if has_failures(checks):
        blocking = [found for found in checks if found.failed]
        raise ValidationError("the loaded tables break a blocking check", blocking)

    info = build_info(version, preflight, measured, (customers, ledger), dataset)
    audit = spark.createDataFrame(info, BUILD_INFO)
    audit.coalesce(1).write.mode("append").parquet(version.build_info)
    results = check_frame(spark, checks).select(F.lit(version.build_id).alias("build_id"), "*")
    results.coalesce(1).write.mode("append").parquet(version.validation_results)

    # Read once more from what will be published.
    counts = [spark.read.parquet(path).count() for path in schemas]
    if counts != [measured["customer_rows"], measured["row_count"]]:
        raise BuildError(f"the finished tables hold {counts} rows, other than were checked")
    try:
        publish(spark, version, replaces=before.build_id if before else None)
    except PublishConflict as error:
        problem = check(
            "database.publish",
            False,
            "",
            "Another build was published while this one ran.",
            replaces=before.build_id if before else None,
        )
        raise ValidationError(str(error), [problem]) from error
    return Build(version, *counts, checks)


def structure_checks(
    spark: SparkSession, expected: Mapping[str, T.StructType]
) -> list[Check]:
    """Whether all tables are there with the declared names, order and types."""
    found: dict[str, T.StructType] = {}
    for path in expected:
        try:
            found[path] = spark.read.parquet(path).schema
        except AnalysisException:
            continue
    missing = [_table_name(path) for path in expected if path not in found]
    other = [
        _table_name(path)
        for path, schema in found.items()
        if _shape(schema) != _shape(expected[path])
    ]
    columns = {f"{_table_name(path)}_columns": len(found[path].fields) for path in found}
    return [
        check(
            "database.schemas",
            not missing,
            "All tables are there.",
            "Some tables are missing.",
            missing=missing,
        ),
        check(
            "database.table_definitions",
            not missing and not other,
            "All tables are as declared.",
            "Some tables are not as declared.",
            different=other,
            **columns,
        ),
    ]


def table_measures(
    customers: DataFrame, ledger: DataFrame, customer_key: str, columns: LedgerColumns
) -> dict[str, object]:
    """What the checks on a loaded pair of tables need.

    The ledger is read twice: row by row measures come with the bitmaps of its keys, and
    everything per customer follows from the groups of repeated rows.
    """
    ids = customers.groupBy(F.col(customer_key).alias("id")).agg(F.count("*").alias("n"))
    customer_part = ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("customer_rows"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias(
            "customer_null_ids"
        ),
        F.count("id").alias("customer_ids"),
    )
    groups = stage(
        repeat_counts(ledger, columns.repeat_keys, columns.repeat_flag).select(
            F.col(columns.customer).alias("customer_id"), "copies", "flagged"
        ),
        "loaded_groups",
    )
    per_customer = groups.groupBy("customer_id").agg(F.sum("copies").alias("ledger_count"))
    return measure(
        customer_part,
        row_key_integrity(ledger, columns.row_key, _ledger_measures(columns)),
        repeat_totals(groups),
        relationships.orphans(per_customer, customers, F.col(customer_key)),
    )


def _ledger_measures(columns: LedgerColumns) -> dict[str, tuple[Column, Callable[[str], Column]]]:
    """Total, dates and missing values of a ledger: of some rows, and how parts are put together."""
    missing = {f"{name}_nulls": F.col(name).isNull() for name in columns.required}
    missing["required_null_rows"] = reduce(lambda a, b: a | b, missing.values())

    def added(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return {
        "total_amount": (
            F.sum(F.col(columns.amount).cast("decimal(28,2)")),
            lambda name: F.sum(name).cast("decimal(38,2)"),
        ),
        "minimum_date": (F.min(columns.day), F.min),
        "maximum_date": (F.max(columns.day), F.max),
        **{name: (count_where(condition), added) for name, condition in missing.items()},
    }


def post_load_checks(
    measured: Measures,
    preflight: Preflight,
    keys: tuple[str, str],
    columns: LedgerColumns,
) -> list[Check]:
    """Checks of the loaded tables against the raw sources."""
    expected_customers, expected_rows = (preflight.manifest[key]["data_rows"] for key in keys)
    raw = preflight.measures[keys[1]]
    ledger_names = ("total_amount", "minimum_date", "maximum_date")
    repeat_names = ("duplicate_groups", "excess_duplicate_rows")
    return [
        check(
            "database.row_counts",
            measured["customer_rows"] == expected_customers
            and measured["row_count"] == expected_rows,
            "As many rows were loaded as the sources have.",
            "The loaded rows differ in number from the sources.",
            expected_customers=expected_customers,
            loaded_customers=measured["customer_rows"],
            expected_transactions=expected_rows,
            loaded_transactions=measured["row_count"],
        ),
        customer_key_check("database.customer_primary_key", measured),
        check(
            "database.transaction_surrogate_key",
            measured["sequential"],
            "Row keys are sequential.",
            "Row keys are not sequential.",
            **pick(measured, *KEY_METRICS),
        ),
        check(
            "database.transaction_required_values",
            measured["required_null_rows"] == 0,
            "No required value is missing.",
            "Some required values are missing.",
            **pick(measured, *[f"{name}_nulls" for name in columns.required]),
        ),
        orphan_check("database.transaction_customers", measured),
        check(
            "database.transaction_ledger",
            pick(measured, *ledger_names) == pick(raw, *ledger_names),
            "Total and dates are those of the raw ledger.",
            "Total or dates differ from the raw ledger.",
            expected_total_amount_cop=raw["total_amount"],
            loaded_total_amount_cop=measured["total_amount"],
            expected_minimum_date=raw["minimum_date"],
            loaded_minimum_date=measured["minimum_date"],
            expected_maximum_date=raw["maximum_date"],
            loaded_maximum_date=measured["maximum_date"],
        ),
        check(
            "database.duplicate_looking_flags",
            measured["flagged_rows"] == measured["rows_in_duplicate_groups"]
            and pick(measured, *repeat_names) == pick(raw, *repeat_names),
            "Exactly the repeated rows are flagged.",
            "The flags differ from the repeated rows.",
            **pick(measured, *FLAG_METRICS),
            **{f"expected_{name}": raw[name] for name in repeat_names},
        ),
    ]


def customer_key_check(code: str, measured: Measures) -> Check:
    """Whether every customer has an id of its own."""
    missing = measured["customer_null_ids"]
    repeated = measured["customer_rows"] - measured["customer_ids"]
    return check(
        code,
        missing == 0 and repeated == 0,
        "Every customer has an id of its own.",
        "Some customer ids are missing or occur twice.",
        null_ids=missing,
        duplicate_id_rows=repeated,
    )


def orphan_check(code: str, measured: Measures) -> Check:
    """Whether every ledger row has a customer."""
    return check(
        code,
        measured["orphan_rows"] == 0,
        "Every ledger row has a customer.",
        "Some ledger rows have no customer.",
        orphan_transaction_rows=measured["orphan_rows"],
    )


def build_info(
    version: Version,
    preflight: Preflight,
    measured: Measures,
    contracts: tuple[SourceContract, SourceContract],
    dataset: Dataset,
) -> list[dict[str, object]]:
    """One audit row per source."""
    now = datetime.now(UTC)
    loaded = [
        ("customers", measured["customer_rows"], None, None),
        (
            "transactions",
            measured["row_count"],
            measured["minimum_date"],
            measured["maximum_date"],
        ),
    ]
    rows = []
    for contract, (table, count, first, last) in zip(contracts, loaded, strict=True):
        source = preflight.manifest[contract.key]
        rows.append(
            {
                "build_id": version.build_id,
                "built_at_utc": now,
                "source_key": contract.key,
                "dataset_name": dataset.name,
                "dataset_version": dataset.version,
                "dataset_source_url": dataset.source_url,
                "source_filename": contract.filename,
                "source_fingerprint": source["fingerprint"],
                "source_byte_size": source["byte_size"],
                "source_row_count": source["data_rows"],
                "loaded_schema": "source",
                "loaded_table": table,
                "loaded_row_count": count,
                "minimum_date": first,
                "maximum_date": last,
                "spark_version": pyspark.__version__,
                "python_version": platform.python_version(),
            }
        )
    return rows


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(field.name, field.dataType.simpleString()) for field in schema.fields]


def _table_name(path: str) -> str:
    return path.rsplit("/", 1)[1]
