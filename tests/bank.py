"""Small retail-bank inputs."""

from dataclasses import replace
from datetime import date
from pathlib import Path

from tallywright.contracts import CUSTOMERS, TRANSACTIONS

LEDGER_LINES = [
    "101,2023-01-04,10.00,Payment",
    "202,2023-01-05,12.50,Transfer",
    "202,2023-01-05,12.50,Transfer",
]
CUSTOMER_ROWS = [
    {"customer_id": "101", "credit_card": "True"},
    {"customer_id": "202", "credit_card": "False"},
]


def contracts(customers=2, transactions=3):
    """The bank contracts, expecting so many rows and files of any content."""
    anything = {"expected_bytes": None, "expected_fingerprint": None}
    return {
        "customers": replace(CUSTOMERS, expected_rows=customers, **anything),
        "ledger": replace(TRANSACTIONS, expected_rows=transactions, **anything),
    }


def customer_lines(rows):
    return [",".join(row.get(name, "") for name in CUSTOMERS.columns) for row in rows]


def write_raw(directory: Path, *, customers=CUSTOMER_ROWS, ledger=LEDGER_LINES, header=None):
    """The two CSV files of a raw directory."""
    directory.mkdir(parents=True, exist_ok=True)
    head = header or ",".join(CUSTOMERS.columns)
    lines = [head, *customer_lines(customers)]
    (directory / CUSTOMERS.filename).write_text("\n".join(lines) + "\n")
    lines = ["customer_id,date,amount,type", *ledger]
    (directory / TRANSACTIONS.filename).write_text("\n".join(lines) + "\n")
    return str(directory)


WORKING_COLUMNS = (
    "customer_id long, first_transaction_date date, last_transaction_date date, "
    "observed_days long, recency_days long, transactions_full_period long, "
    "transactions_recent_90d long, transactions_prior_90d long, active_months long, "
    "sufficient_prior_history boolean"
)
WORKING_ROWS = [
    (101, date(2023, 1, 4), date(2023, 12, 19), 360, 10, 20, 5, 4, 10, True),
    (202, date(2023, 2, 1), date(2023, 11, 19), 332, 40, 15, 3, 4, 8, True),
    (303, date(2023, 3, 1), date(2023, 10, 20), 304, 70, 12, 1, 3, 7, True),
    (404, date(2023, 8, 1), date(2023, 9, 20), 151, 100, 10, 0, 0, 4, False),
]


def working(spark, rows=WORKING_ROWS):
    return spark.createDataFrame(rows, WORKING_COLUMNS)

