from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from decimal import Decimal

import pytest
from bank import CUSTOMER_ROWS, LEDGER_LINES, contracts, write_raw
from pyspark.sql import functions as F

from tallywright.contracts import LedgerColumns
from tallywright.operators import checks
from tallywright.operators.checks import has_failures
import tallywright.plans.build as build_plan
from tallywright.plans.build import BuildError, ValidationError, build
from tallywright.plans.health import inspect_health
from tallywright.sources.paths import claim, folders
from tallywright.sources.reports import write_report
from tallywright.sources.versions import (
    PublishConflict,
    Version,
    publish,
    published_version,
    read_published,
    remove_versions,
)


def codes(checks, status):
    return {found.code for found in checks if found.status == status}


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bank")
    target = str(root / "published")
    result = build(spark, write_raw(root / "raw"), target, **contracts())
    return root, target, result


def test_build(spark, published):
    _, target, result = published
    assert (result.customer_rows, result.ledger_rows, result.warnings) == (2, 3, 2)
    customers, ledger = read_published(spark, target)
    assert len(customers.columns) == 54
    assert ledger.orderBy("transaction_row_id").collect() == [
        (1, 101, date(2023, 1, 4), Decimal("10.00"), "Payment", False),
        (2, 202, date(2023, 1, 5), Decimal("12.50"), "Transfer", True),
        (3, 202, date(2023, 1, 5), Decimal("12.50"), "Transfer", True),
    ]
    holders = {row["customer_id"]: row["credit_card"] for row in customers.collect()}
    assert holders == {101: True, 202: False}


def test_audit_rows(spark, published):
    _, _, result = published
    info = {r["source_key"]: r for r in spark.read.parquet(result.version.build_info).collect()}
    assert set(info) == {"customers", "transactions"}
    ledger = info["transactions"]
    assert (ledger["source_row_count"], ledger["loaded_row_count"]) == (3, 3)
    assert (ledger["minimum_date"], ledger["maximum_date"]) == (
        date(2023, 1, 4),
        date(2023, 1, 5),
    )
    assert ledger["source_fingerprint"].startswith("4:")
    assert info["customers"]["minimum_date"] is None
    stored = spark.read.parquet(result.version.validation_results)
    assert stored.count() == len(result.checks)
    baseline = stored.filter(F.col("check_code") == "database.transaction_ledger").first()
    assert '"expected_total_amount_cop":"35.00"' in baseline["metrics"]
    assert '"expected_minimum_date":"2023-01-04"' in baseline["metrics"]


def test_healthy(spark, published):
    _, target, _ = published
    health = inspect_health(spark, target, **contracts())
    assert not health.failed
    assert {
        "persisted.transactions.duplicate_looking_rows",
        "persisted.relationships.publisher_derived_aggregates",
    } == codes(health.checks, "warning")
    assert health.checks[-1].code == "health.full_table_scan"


def test_health_report(spark, published, tmp_path):
    _, target, _ = published
    health = inspect_health(spark, target, **contracts())
    write_report(spark, str(tmp_path / "health"), health.checks, {}, health.details)
    prints = spark.read.json(str(tmp_path / "health" / "logical_fingerprints"))
    assert {row["table_name"]: row["row_count"] for row in prints.collect()} == {
        "customers": 2,
        "transactions": 3,
    }


def test_existing_target_is_kept(spark, published):
    root, target, result = published
    with pytest.raises(BuildError, match="replace=True"):
        build(spark, str(root / "raw"), target, **contracts())
    assert published_version(spark, target) == result.version


def test_failed_replacement_keeps_the_published_version(spark, published):
    root, target, result = published
    orphan = write_raw(root / "orphan", ledger=["999,2023-01-04,10.00,Payment", *LEDGER_LINES[1:]])
    with pytest.raises(ValidationError) as caught:
        build(spark, orphan, target, replace=True, **contracts())
    assert codes(caught.value.checks, "fail") == {"relationships.transaction_customers"}
    assert published_version(spark, target) == result.version
    assert read_published(spark, target)[1].count() == 3


def test_replacement_publishes_a_new_version(spark, published, tmp_path):
    root, _, _ = published
    target = str(tmp_path / "other")
    first = build(spark, str(root / "raw"), target, **contracts())
    second = build(spark, str(root / "raw"), target, replace=True, **contracts())
    assert published_version(spark, target) == second.version != first.version
    assert spark.read.parquet(first.version.ledger).count() == 3


def test_bad_value_fails_before_the_load(spark, tmp_path):
    raw = write_raw(tmp_path / "raw", ledger=["101,2023-13-04,10.00,Payment", *LEDGER_LINES[1:]])
    with pytest.raises(ValidationError) as caught:
        build(spark, raw, str(tmp_path / "target"), **contracts())
    assert codes(caught.value.checks, "fail") == {"transactions.schema_parseability"}
    assert published_version(spark, str(tmp_path / "target")) is None


def test_duplicate_customer_fails(spark, tmp_path):
    raw = write_raw(tmp_path / "raw", customers=[*CUSTOMER_ROWS, CUSTOMER_ROWS[0]])
    with pytest.raises(ValidationError) as caught:
        build(spark, raw, str(tmp_path / "target"), **contracts(customers=3))
    assert "customers.primary_key" in codes(caught.value.checks, "fail")


def test_nothing_published(spark, tmp_path):
    health = inspect_health(spark, str(tmp_path / "nowhere"), **contracts())
    assert codes(health.checks, "fail") == {"health.database_file"}
    with pytest.raises(FileNotFoundError):
        read_published(spark, str(tmp_path / "nowhere"))


def drifted(spark, published, tmp_path, **tables):
    """A copy of the published version with some tables replaced."""
    _, _, result = published
    version = Version(str(tmp_path / "drifted"), "copy")
    for name in ("customers", "ledger", "build_info", "validation_results"):
        df = spark.read.parquet(getattr(result.version, name))
        df = tables[name](df) if name in tables else df
        if df is not None:
            df.write.parquet(getattr(version, name))
    publish(spark, version)
    health = inspect_health(spark, version.target, **contracts())
    assert has_failures(health.checks)
    return codes(health.checks, "fail")


def test_drift_in_audit_rows(spark, published, tmp_path):
    failed = drifted(
        spark,
        published,
        tmp_path,
        build_info=lambda df: df.withColumn("loaded_row_count", F.lit(99).cast("bigint")),
    )
    assert failed == {"health.build_metadata", "health.row_counts"}


def test_drift_in_ledger(spark, published, tmp_path):
    failed = drifted(
        spark, published, tmp_path, ledger=lambda df: df.filter("transaction_row_id < 3")
    )
    assert failed == {
        "health.row_counts",
        "health.transaction_ledger",
        "health.duplicate_looking_flags",
    }


def test_drift_in_keys(spark, published, tmp_path):
    failed = drifted(
        spark,
        published,
        tmp_path,
        customers=lambda df: df.filter("customer_id = 101").unionByName(
            df.filter("customer_id = 101")
        ),
        ledger=lambda df: df.withColumn("transaction_row_id", F.col("transaction_row_id") + 1),
    )
    assert failed == {
        "health.customer_keys",
        "health.transaction_contract",
        "health.transaction_customers",
    }


def test_missing_baseline(spark, published, tmp_path):
    failed = drifted(
        spark,
        published,
        tmp_path,
        validation_results=lambda df: df.filter("check_code != 'database.transaction_ledger'"),
    )
    assert failed == {"health.transaction_ledger"}


def test_unreadable_baseline(spark, published, tmp_path):
    failed = drifted(
        spark,
        published,
        tmp_path,
        validation_results=lambda df: df.withColumn("metrics", F.lit("{broken")),
    )
    assert failed == {"health.transaction_ledger"}


def test_stored_failure(spark, published, tmp_path):
    fail = F.when(F.col("check_ordinal") == 1, "fail").otherwise(F.col("status"))
    failed = drifted(
        spark,
        published,
        tmp_path,
        validation_results=lambda df: df.withColumn("status", fail),
    )
    assert failed == {"health.persisted_validations", "persisted.customers.file_readable"}


def test_missing_table(spark, published, tmp_path):
    failed = drifted(spark, published, tmp_path, build_info=lambda df: None)
    assert failed == {"health.database_open", "database.schemas", "database.table_definitions"}


def test_wrong_structure(spark, published, tmp_path):
    failed = drifted(
        spark,
        published,
        tmp_path,
        ledger=lambda df: df.withColumn("amount_cop", F.col("amount_cop").cast("double")),
    )
    assert failed == {"database.table_definitions"}


def test_the_number_of_a_publish_decides_not_the_clock(spark, tmp_path):
    target = str(tmp_path / "numbered")
    assert published_version(spark, target) is None
    for name in ("first", "second", "third"):
        publish(spark, Version(target, name))
    log = spark.read.option("recursiveFileLookup", True).parquet(f"{target}/publishes")
    assert {row.publish_number: row.build_id for row in log.collect()} == {1: "first", 2: "second", 3: "third"}
    # A later number with an earlier time.
    log.filter("publish_number = 1").selectExpr(
        "4L as publish_number", "'fourth' as build_id", "published_at_utc - interval 9 days as published_at_utc"
    ).coalesce(1).write.parquet(f"{target}/publishes/0000000004")
    assert published_version(spark, target).build_id == "fourth"


def test_a_log_that_names_nothing_is_an_error(spark, tmp_path):
    target = str(tmp_path / "odd")
    spark.range(1).selectExpr("id as other").write.parquet(f"{target}/publishes/0000000001")
    with pytest.raises(ValueError, match="names no version"):
        published_version(spark, target)


def test_of_builders_that_publish_at_once_one_wins(spark, tmp_path):
    target = str(tmp_path / "race")

    def attempt(number):
        try:
            publish(spark, Version(target, f"build-{number}"), replaces=None)
            return number
        except PublishConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [number for number in pool.map(attempt, range(8)) if number is not None]
    assert len(won) == 1
    assert published_version(spark, target).build_id == f"build-{won[0]}"


def test_without_a_condition_all_publish_under_numbers_of_their_own(spark, tmp_path):
    target = str(tmp_path / "all")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: publish(spark, Version(target, f"b{n}")), range(4)))
    log = spark.read.option("recursiveFileLookup", True).parquet(f"{target}/publishes").collect()
    assert {row.publish_number for row in log} == {1, 2, 3, 4}
    assert {row.build_id for row in log} == {"b0", "b1", "b2", "b3"}


def test_the_number_of_a_dead_builder_is_passed_over(spark, tmp_path):
    target = str(tmp_path / "dead")
    publish(spark, Version(target, "first"))
    assert claim(spark, f"{target}/claims/{2:010d}")
    publish(spark, Version(target, "third"), replaces="first", patience=0.3)
    assert published_version(spark, target).build_id == "third"
    with pytest.raises(PublishConflict):
        publish(spark, Version(target, "late"), replaces="first")


def test_a_build_overtaken_by_another_fails_with_a_check(spark, published, tmp_path, monkeypatch):
    root, _, _ = published
    target = str(tmp_path / "overtaken")
    first = build(spark, str(root / "raw"), target, **contracts())
    ordinary = build_plan.publish

    def overtaken(spark, version, **arguments):
        ordinary(spark, Version(target, "faster"))
        ordinary(spark, version, **arguments)

    monkeypatch.setattr(build_plan, "publish", overtaken)
    with pytest.raises(ValidationError) as failed:
        build(spark, str(root / "raw"), target, replace=True, **contracts())
    assert [check.code for check in failed.value.checks] == ["database.publish"]
    assert published_version(spark, target).build_id == "faster"
    assert set(folders(spark, f"{target}/versions")) == {first.version.build_id}


def test_old_and_unpublished_versions_go(spark, tmp_path):
    target = str(tmp_path / "old")
    for name in ("a", "b", "c", "orphan"):
        spark.range(1).write.parquet(Version(target, name).customers)
        if name != "orphan":
            publish(spark, Version(target, name))
    assert remove_versions(spark, target) == []  # all too young
    assert remove_versions(spark, target, keep=2, unchanged_for=timedelta(0)) == ["a", "orphan"]
    assert remove_versions(spark, target, unchanged_for=timedelta(0)) == ["b"]
    assert set(folders(spark, f"{target}/versions")) == {"c"}
    with pytest.raises(ValueError, match="stay"):
        remove_versions(spark, target, keep=0)


def test_the_ledger_is_measured_in_two_scans(spark, published, monkeypatch):
    _, target, _ = published
    customers, ledger = read_published(spark, target)
    plans = []
    ordinary = build_plan.stage

    def staged(df, name):
        plans.append(df)
        return ordinary(df, name)

    def measured(*parts):
        plans.extend(parts)
        return checks.measure(*parts)

    monkeypatch.setattr(build_plan, "stage", staged)
    monkeypatch.setattr(build_plan, "measure", measured)
    build_plan.table_measures(customers, ledger, "customer_id", LedgerColumns())
    scans = [plan._jdf.queryExecution().analyzed().toString() for plan in plans]
    assert sum("transaction_row_id" in plan or "is_duplicate_looking" in plan for plan in scans) == 2
