import json
from dataclasses import replace
from datetime import date
from decimal import Decimal

from bank import CUSTOMER_ROWS, LEDGER_LINES, contracts, write_raw
from pyspark.sql import functions as F

from tallywright.contracts import CUSTOMERS, TRANSACTIONS
from tallywright.operators import checks as C
from tallywright.operators import relationships
from tallywright.sources.raw_text import file_manifest, source_manifest
from tallywright.plans.preflight import check_contents, run_preflight
from tallywright.sources import raw_text
from tallywright.sources.reports import write_report


def statuses(run):
    return {found.code: found.status for found in run.checks}


def test_no_files(spark, tmp_path):
    run = run_preflight(spark, str(tmp_path))
    assert statuses(run) == {"customers.file_exists": "fail", "transactions.file_exists": "fail"}


def test_other_files_than_expected(spark, tmp_path):
    run = run_preflight(spark, write_raw(tmp_path / "raw"))
    failed = {found.code for found in run.checks if found.failed}
    assert failed == {
        f"{key}.{code}"
        for key in ("customers", "transactions")
        for code in ("byte_size", "row_count")
    }
    assert "files.csv_readability" not in statuses(run)


def test_fingerprint_is_checked(spark, tmp_path):
    raw = write_raw(tmp_path / "raw")
    run = run_preflight(spark, raw, **contracts())
    expected = contracts()
    own = run.manifest["transactions"]["fingerprint"]
    expected["ledger"] = replace(expected["ledger"], expected_fingerprint=own)
    assert statuses(run_preflight(spark, raw, **expected))["transactions.checksum"] == "pass"
    path = tmp_path / "raw" / TRANSACTIONS.filename
    path.write_bytes(path.read_bytes().replace(b"10.00", b"10.01"))
    assert statuses(run_preflight(spark, raw, **expected))["transactions.checksum"] == "fail"


def test_fingerprint_counts_repeated_lines_and_ignores_splits(spark, tmp_path):
    wanted = replace(TRANSACTIONS, filename="lines")
    header = ",".join(TRANSACTIONS.columns)

    def fingerprint(*files):
        folder = tmp_path / f"run{len(list(tmp_path.iterdir()))}" / "lines"
        folder.mkdir(parents=True)
        for number, lines in enumerate(files):
            (folder / f"{number}.csv").write_text("\n".join(lines) + "\n")
        found = source_manifest(file_manifest(spark, str(folder.parent), [wanted]), [wanted])
        return found.first()["fingerprint"]

    first = ["1,2023-01-04,1.00,P"] * 2
    second = ["9,2023-05-05,7.77,Q"] * 2
    assert fingerprint([header, *first]) != fingerprint([header, *second])
    many = [header, *(f"{i},2023-01-04,1.00,P" for i in range(5000))]
    whole = fingerprint(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert fingerprint(many) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert fingerprint(many[:100], many[100:]) == whole


def test_missing_directory_fails_two_checks(spark, tmp_path):
    run = run_preflight(spark, str(tmp_path / "nowhere"), **contracts())
    assert statuses(run) == {f"{key}.file_exists": "fail" for key in ("customers", "transactions")}


def test_all_quiet(spark, tmp_path):
    summaries = {
        "tx_count": "1",
        "total_tx_volume": "10.00",
        "total_transaction_volume": "10",
        "first_tx": "2023-01-04",
        "first_transaction_date": "2023-01-04",
        "last_tx": "2023-01-04",
        "last_transaction_date": "2023-01-04",
    }
    raw = write_raw(
        tmp_path / "raw",
        customers=[{**CUSTOMER_ROWS[0], **summaries, "age": "40", "gender": "Female"}],
        ledger=LEDGER_LINES[:1],
    )
    run = run_preflight(spark, raw, **contracts(1, 1))
    assert set(statuses(run).values()) == {"pass"}
    assert len(run.checks) == 20
    assert run.profiles["flag_holders"].first()["flag_holders"] == 1

    out = tmp_path / "report"
    measures = {"files": run.manifest, **run.measures}
    write_report(spark, str(out), run.checks, measures, run.profiles)
    document = json.loads(spark.read.text(str(out / "report")).first()["value"])
    assert document["summary"] == {"pass": 20, "warning": 0, "fail": 0}
    assert len(document["checks"]) == 20
    assert document["measures"]["files"]["transactions"]["data_rows"] == 1
    assert document["measures"]["transactions"]["total_amount"] == "10.00"
    assert document["measures"]["transactions"]["minimum_date"] == "2023-01-04"
    categories = spark.read.json(str(out / "transactions_categories")).collect()
    assert [row["value"] for row in categories] == ["Payment"]


def text_table(spark, contract, rows):
    return spark.createDataFrame(rows, ", ".join(f"{name} string" for name in contract.columns))


def test_every_content_check_fires(spark):
    customers = [
        {"customer_id": "1", "age": "forty", "gender": "female", "nps_score": "-101"},
        {"customer_id": "2", "first_tx": "2023", "avg_tx_value": "1d", "age": "17"},
        {"customer_id": "2", "churn_probability": "1.01", "household_size": "0"},
        {"customer_id": "", "age": "101", "app_store_rating": "0.5", "tx_count": "-"},
        {"customer_id": "x", "savings_account": "maybe", "failed_transactions": "-1"},
    ]
    ledger = [
        "1,2023-01-04,10.00,Payment",
        "1,2023-01-04,10.0, Payment",
        "2,2023-01-04,ten,Payment",
        "2,04/01/2023,0,Gift",
        "2,2024-01-04,-1,Deposit",
        "2,,5.00, ",
        "999,2023-01-05,5.00,Deposit",
    ] + [f"1,2023-02-0{n},{n},Deposit" for n in range(1, 10)]
    checks, measures = check_contents(
        text_table(
            spark, CUSTOMERS, [tuple(row.get(c) for c in CUSTOMERS.columns) for row in customers]
        ),
        text_table(spark, TRANSACTIONS, [tuple(line.split(",")) for line in ledger]),
        customers=CUSTOMERS,
        ledger=TRANSACTIONS,
        observed=(date(2023, 1, 4), date(2023, 12, 29)),
    )
    found = {check.code: check for check in checks}
    quiet = "relationships.transaction_count_concentration"
    assert {code for code, check in found.items() if check.status == "pass"} == {quiet}

    failures = measures["customers"]["parse_failures"]
    assert {name: n for name, n in failures.items() if n} == {
        "customer_id": 1,
        "age": 1,
        "savings_account": 1,
        "avg_tx_value": 1,
        "first_tx": 1,
        "tx_count": 1,
    }
    assert found["customers.primary_key"].metrics == {
        "null_ids": 1,
        "duplicate_id_rows": 2,
        "distinct_ids": 2,
    }
    assert found["customers.categories"].metrics["unexpected_values"] == {
        "gender": {"rows": 1, "values": 1},
        "savings_account": {"rows": 1, "values": 1},
    }
    outside = found["customers.business_ranges"].metrics
    assert {name: n for name, n in outside.items() if n} == {
        "age_outside_expected_range": 2,
        "household_size_below_one": 1,
        "negative_failed_transactions": 1,
        "churn_probability_outside_zero_one": 1,
        "nps_outside_expected_range": 1,
        "app_rating_outside_expected_range": 1,
    }
    assert found["transactions.schema_parseability"].metrics["failed_values"] == 2
    assert found["transactions.required_values"].metrics["by_column"] == {
        "customer_id": 0,
        "date": 1,
        "amount": 0,
        "type": 1,
    }
    assert found["transactions.categories"].metrics["unexpected_rows"] == 1
    assert found["transactions.ranges"].metrics == {
        "zero_amount_rows": 1,
        "negative_amount_rows": 1,
        "dates_outside_observation_window": 1,
    }
    assert found["transactions.duplicate_looking_rows"].metrics["duplicate_groups"] == 1
    assert found["relationships.transaction_customers"].metrics == {
        "orphan_transaction_rows": 1,
        "orphan_customer_ids": 1,
    }
    without = found["relationships.customers_without_transactions"].metrics
    assert without == {"customers_without_transactions": 2}
    compared = found["relationships.publisher_derived_aggregates"].metrics
    assert compared["customers_compared"] == 3
    assert compared["tx_count_mismatches"] == 3


def test_concentration(spark):
    counts = [(n, 1) for n in range(40)] + [(99, 60)]
    per_customer = spark.createDataFrame(counts, "customer_id long, ledger_count long")
    found = relationships.concentration(relationships.count_distribution(per_customer)).first()
    assert (found["maximum"], found["p95"], found["concentrated"]) == (60, 1.0, True)


def test_malformed_lines_stop_the_run(spark, tmp_path):
    raw = write_raw(tmp_path / "raw", ledger=[*LEDGER_LINES[:2], "101,2023-01-06"])
    run = run_preflight(spark, raw, **contracts())
    assert run.checks[-1].code == "files.csv_readability" and run.checks[-1].failed


def test_other_header(spark, tmp_path):
    names = CUSTOMERS.columns
    swapped = ",".join([names[1], names[0], *names[2:-1], "extra"])
    run = run_preflight(spark, write_raw(tmp_path / "raw", header=swapped), **contracts())
    header = next(found for found in run.checks if found.code == "customers.header")
    assert header.failed
    assert header.metrics["missing_columns"] == [names[-1]]
    assert header.metrics["unexpected_columns"] == ["extra"]


def test_garbled_file(spark, tmp_path):
    raw = write_raw(tmp_path / "raw")
    (tmp_path / "raw" / TRANSACTIONS.filename).write_bytes(b"customer_id,date\n\xff\xfe,1\n")
    found = statuses(run_preflight(spark, raw, **contracts()))
    assert found["transactions.file_structure"] == "fail"
    assert found["customers.row_count"] == "pass"


def test_header_names(spark):
    line = spark.createDataFrame([('a,"b,c","say ""hi""",d\r',)], "line string")
    names = line.select(raw_text.header_names(F.col("line")).alias("n")).first()["n"]
    assert names == ["a", "b,c", 'say "hi"', "d"]


def test_sources_of_many_files(spark, tmp_path):
    directory = tmp_path / "raw"
    write_raw(directory)
    (directory / TRANSACTIONS.filename).unlink()
    parts = directory / TRANSACTIONS.filename
    parts.mkdir()
    for number, line in enumerate(LEDGER_LINES):
        (parts / f"part-{number}.csv").write_text(f"customer_id,date,amount,type\n{line}\n")
    run = run_preflight(spark, str(directory), **contracts())
    assert not run.failed
    assert run.manifest["transactions"]["files"] == 3
    assert run.manifest["transactions"]["data_rows"] == 3


def test_quoted_fields(spark, tmp_path):
    raw = write_raw(tmp_path / "raw", ledger=['101,2023-01-04,"10.00","Pay, ""now"""'])
    row = raw_text.read_text_table(spark, TRANSACTIONS, raw).first()
    assert row["type"] == 'Pay, "now"'


def test_metrics_json():
    text = C.metrics_json({"b": Decimal("12.30"), "a": date(2023, 1, 4), "c": None})
    assert text == '{"a":"2023-01-04","b":"12.30","c":null}'
    assert json.loads(text)["b"] == "12.30"


def test_status_counts(spark):
    rows = [C.check("a", True, "good", "bad"), C.check("b", None, "good", "bad", breach="warning")]
    counts = C.status_counts(C.check_frame(spark, rows)).collect()
    assert [tuple(row) for row in counts] == [("pass", 1), ("warning", 1), ("fail", 0)]
    assert not C.has_failures(rows)
