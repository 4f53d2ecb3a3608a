"""Checks and profiles of a pair of raw sources: customers and their ledger."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.contracts import BANK_OBSERVED, BIGINT, CUSTOMERS, TRANSACTIONS, SourceContract
from tallywright.functions.text import lenient_cast, lenient_table, typed_name
from tallywright.operators import profile, relationships
from tallywright.operators.checks import WARNING, Check, check, has_failures, measure, pick
from tallywright.operators.repeats import repeat_profile
from tallywright.sources.raw_text import (
    file_manifest,
    header_contract,
    header_summary,
    scanned_counts,
    source_manifest,
    stage_text_table,
)
from tallywright.sources.scratch import stage

Measures = Mapping[str, object]


# -- measures: what Spark computes ---------------------------------------------


def customer_measures(raw: DataFrame, contract: SourceContract) -> dict[str, object]:
    """What the customer checks need."""
    rows = lenient_table(raw, contract.types).agg(*profile.source_measures(contract))
    keys = profile.key_profile(raw, contract.id_column, contract.types[contract.id_column])
    return measure(rows, keys, _unexpected(raw, contract))


def ledger_measures(
    raw: DataFrame, contract: SourceContract, observed: tuple[date, date]
) -> dict[str, object]:
    """What the ledger checks need."""
    table = lenient_table(raw, contract.types)
    day, amount = (F.col(typed_name(c)) for c in (contract.day_column, contract.amount_column))
    described = profile.ledger_measures(day, amount, observed)
    described.pop("row_count")
    rows = table.agg(
        *profile.source_measures(contract),
        *[value.alias(name) for name, value in described.items()],
    )
    # Repeats are found on typed values, as in the loaded table.
    values = raw.select(*[_typed(contract, name).alias(name) for name in contract.repeat_columns])
    repeats = repeat_profile(values, contract.repeat_columns)
    return measure(rows, _unexpected(raw, contract), repeats)


def raw_per_customer(raw: DataFrame, contract: SourceContract) -> DataFrame:
    """The raw ledger as one row per customer id."""
    return relationships.ledger_per_customer(
        raw,
        lenient_cast(contract.id_column, BIGINT),
        _typed(contract, contract.day_column),
        _typed(contract, contract.amount_column),
    )


def relationship_measures(
    customers_raw: DataFrame, customers: SourceContract, per_customer: DataFrame
) -> dict[str, object]:
    """What the relationship checks need."""
    key = lenient_cast(customers.id_column, BIGINT)
    parts = [
        relationships.orphans(per_customer, customers_raw, key),
        relationships.childless(customers_raw, key, per_customer),
        relationships.concentration(relationships.count_distribution(per_customer)),
    ]
    if customers.summaries:
        claims = {
            name: (_claim(customers, name, kind), kind)
            for name, kind in customers.summaries.items()
        }
        parts.append(relationships.reconcile(customers_raw, key, per_customer, claims))
    return measure(*parts)


# -- checks: what the measures mean ---------------------------------------------


def file_checks(
    found: Measures, headers: Measures | None, contract: SourceContract
) -> list[Check]:
    """Presence, size, hash, header and line count of one source."""
    key, name = contract.key, contract.filename
    if not found["files"]:
        return [check(f"{key}.file_exists", False, "", f"{name} is missing.")]
    readable = check(f"{key}.file_readable", True, f"{name} is readable.", "")
    if found["invalid_lines"] or not found["line_count"]:
        garbled = check(
            f"{key}.file_structure",
            False,
            "",
            f"{name} is empty or not UTF-8 text.",
            **pick(found, "line_count", "invalid_lines"),
        )
        return [readable, garbled]

    def expected(code: str, column: str, value: object) -> list[Check]:
        if value is None:
            return []
        good, bad = f"{name}: {code} is as expected.", f"{name}: {code} is not as expected."
        observed = found[column]
        return [
            check(f"{key}.{code}", observed == value, good, bad, expected=value, observed=observed)
        ]

    header = check(
        f"{key}.header",
        headers["order_matches"],
        f"{name} has the declared columns in order.",
        f"{name} has other columns than declared.",
        **headers,
    )
    return [
        readable,
        *expected("byte_size", "byte_size", contract.expected_bytes),
        *expected("checksum", "fingerprint", contract.expected_fingerprint),
        header,
        *expected("row_count", "data_rows", contract.expected_rows),
    ]


def customer_checks(measured: Measures, contract: SourceContract) -> list[Check]:
    """Parseability, key, categories and ranges of the customers."""
    key = contract.key
    checks = [
        _parseability(measured, contract),
        check(
            f"{key}.primary_key",
            measured["null_ids"] == 0 and measured["duplicate_id_rows"] == 0,
            "Every row has an id and no id occurs twice.",
            "Some ids are missing or occur twice.",
            **pick(measured, "null_ids", "duplicate_id_rows", "distinct_ids"),
        ),
        _categories(measured, contract),
    ]
    if contract.ranges:
        outside = measured["ranges"]
        checks.append(
            check(
                f"{key}.business_ranges",
                not any(outside.values()),
                "All values lie within their ranges.",
                "Some values lie outside their ranges.",
                breach=WARNING,
                **outside,
            )
        )
    return checks


def ledger_checks(measured: Measures, contract: SourceContract) -> list[Check]:
    """Parseability, required values, categories, ranges and repeats of the ledger."""
    key = contract.key
    missing = sum(measured["nulls"].values())
    odd = pick(
        measured,
        "zero_amount_rows",
        "negative_amount_rows",
        "dates_outside_observation_window",
    )
    return [
        _parseability(measured, contract),
        check(
            f"{key}.required_values",
            missing == 0,
            "No required value is missing.",
            "Some required values are missing.",
            null_or_empty_values=missing,
            by_column=measured["nulls"],
        ),
        _categories(measured, contract),
        check(
            f"{key}.ranges",
            not any(odd.values()),
            "All dates and amounts lie within their ranges.",
            "Some dates or amounts lie outside their ranges.",
            breach=WARNING,
            **odd,
        ),
        check(
            f"{key}.duplicate_looking_rows",
            measured["excess_duplicate_rows"] == 0,
            "No two rows are the same.",
            "Some rows are exact repeats.",
            breach=WARNING,
            **pick(measured, "duplicate_groups", "excess_duplicate_rows"),
        ),
    ]


def relationship_checks(measured: Measures, customers: SourceContract) -> list[Check]:
    """Orphans, customers without rows, concentration and summary columns."""
    checks = [
        check(
            "relationships.transaction_customers",
            measured["orphan_rows"] == 0,
            "Every ledger row has a customer.",
            "Some ledger rows have no customer.",
            orphan_transaction_rows=measured["orphan_rows"],
            orphan_customer_ids=measured["orphan_ids"],
        ),
        check(
            "relationships.customers_without_transactions",
            measured["customers_without_rows"] == 0,
            "Every customer has ledger rows.",
            "Some customers have no ledger rows.",
            breach=WARNING,
            customers_without_transactions=measured["customers_without_rows"],
        ),
        check(
            "relationships.transaction_count_concentration",
            not measured["concentrated"],
            "No customer has extremely many ledger rows.",
            "A customer has extremely many ledger rows.",
            breach=WARNING,
            **pick(measured, "maximum", "p95", "maximum_to_p95_ratio"),
            review_threshold_ratio=relationships.CONCENTRATION_LIMIT,
        ),
    ]
    if customers.summaries:
        mismatches = pick(measured, *[f"{name}_mismatches" for name in customers.summaries])
        checks.append(
            check(
                "relationships.publisher_derived_aggregates",
                not any(mismatches.values()),
                "The customer summary columns agree with the ledger.",
                "Some customer summary columns disagree with the ledger.",
                breach=WARNING,
                customers_compared=measured["customers_compared"],
                **mismatches,
            )
        )
    return checks


def scan_check(counts: Mapping[str, Measures]) -> Check:
    """Whether every line of every source was read as one record."""
    names = ("expected_rows", "scanned_rows", "malformed_rows")
    return check(
        "files.csv_readability",
        all(found["matches"] for found in counts.values()),
        "Every line of the sources was read as a record.",
        "The records read differ from the lines of the sources.",
        sources={key: pick(found, *names) for key, found in counts.items()},
    )


# -- the whole run ----------------------------------------------------------------


@dataclass
class Preflight:
    """Outcome of a preflight: checks, and what later steps reuse."""

    checks: list[Check] = field(default_factory=list)
    manifest: dict[str, Measures] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    measures: dict[str, Measures] = field(default_factory=dict)
    profiles: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def failed(self) -> bool:
        return has_failures(self.checks)


def check_contents(
    customers_raw: DataFrame,
    ledger_raw: DataFrame,
    *,
    customers: SourceContract,
    ledger: SourceContract,
    observed: tuple[date, date],
) -> tuple[list[Check], dict[str, Measures]]:
    """All checks on the content of two raw tables, and the measures behind them.

    The ledger is reduced to one row per customer once, for all relationships.
    """
    per_customer = stage(raw_per_customer(ledger_raw, ledger), "per_customer")
    measures = {
        customers.key: customer_measures(customers_raw, customers),
        ledger.key: ledger_measures(ledger_raw, ledger, observed),
        "relationships": relationship_measures(customers_raw, customers, per_customer),
    }
    checks = [
        *customer_checks(measures[customers.key], customers),
        *ledger_checks(measures[ledger.key], ledger),
        *relationship_checks(measures["relationships"], customers),
    ]
    return checks, measures


def run_preflight(
    spark: SparkSession,
    directory: str,
    *,
    customers: SourceContract = CUSTOMERS,
    ledger: SourceContract = TRANSACTIONS,
    observed: tuple[date, date] = BANK_OBSERVED,
) -> Preflight:
    """Check a directory of raw sources, stopping early where nothing more can be read.

    Files come first; the text is parsed once, if they are as expected; the
    content is profiled if every line was a record.
    """
    contracts = [customers, ledger]
    run = Preflight()
    files = stage(file_manifest(spark, directory, contracts), "files")
    run.profiles["files"] = files
    run.manifest = _by_source(source_manifest(files, contracts))
    headers = _by_source(header_summary(header_contract(files, contracts)))
    for contract in contracts:
        found = run.manifest[contract.key]
        run.checks += file_checks(found, headers.get(contract.key), contract)
    if run.failed:
        return run

    run.tables = {c.key: stage_text_table(spark, c, directory) for c in contracts}
    counts = scanned_counts(
        [(c, run.tables[c.key]) for c in contracts], source_manifest(files, contracts)
    )
    run.checks.append(scan_check(_by_source(counts)))
    if run.failed:
        return run

    checks, run.measures = check_contents(
        run.tables[customers.key],
        run.tables[ledger.key],
        customers=customers,
        ledger=ledger,
        observed=observed,
    )
    run.checks += checks
    for contract in contracts:
        run.profiles[f"{contract.key}_categories"] = profile.category_profile(
            run.tables[contract.key], list(contract.categories)
        )
    if customers.flag_column:
        run.profiles["flag_holders"] = profile.flag_holders(
            run.profiles[f"{customers.key}_categories"], customers.flag_column
        )
    return run


def _by_source(df: DataFrame) -> dict[str, Measures]:
    found = [row.asDict(recursive=True) for row in df.collect()]
    return {measured.pop("source_key"): measured for measured in found}


def _typed(contract: SourceContract, column: str) -> Column:
    return lenient_cast(column, contract.types[column])


def _claim(contract: SourceContract, column: str, kind: str) -> Column:
    data_type = BIGINT if kind == "count" else contract.types[column]
    return lenient_cast(column, data_type)


def _unexpected(raw: DataFrame, contract: SourceContract) -> DataFrame:
    frequencies = profile.category_profile(raw, list(contract.categories))
    unexpected = profile.unexpected_categories(frequencies, contract.categories)
    return profile.unexpected_summary(unexpected)


def _parseability(measured: Measures, contract: SourceContract) -> Check:
    failures = measured["parse_failures"].values()
    return check(
        f"{contract.key}.schema_parseability",
        not any(failures),
        "Every value fits its declared type.",
        "Some values do not fit their declared type.",
        failed_values=sum(failures),
        affected_columns=sum(failed > 0 for failed in failures),
    )


def _categories(measured: Measures, contract: SourceContract) -> Check:
    return check(
        f"{contract.key}.categories",
        measured["unexpected_rows"] == 0,
        "All categories hold listed values only.",
        "Some categories hold values that are not listed.",
        breach=WARNING,
        unexpected_rows=measured["unexpected_rows"],
        unexpected_values=measured["unexpected_by_column"],
    )
