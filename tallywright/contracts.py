"""What a ledger must look like: columns, types, keys, allow-lists and ranges.

``SourceContract`` describes any raw table. ``CUSTOMERS`` and ``TRANSACTIONS``
are the retail-bank contracts the library ships with.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import types as T

BIGINT = T.LongType()
INTEGER = T.IntegerType()
BOOLEAN = T.BooleanType()
DATE = T.DateType()
DOUBLE = T.DoubleType()
MONEY = T.DecimalType(20, 2)
TEXT = T.StringType()


@dataclass(frozen=True)
class RangeRule:
    """Values below ``low`` or above ``high`` break the rule; NULL does not."""

    name: str
    column: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class SourceContract:
    """Declared shape of one raw text source.

    The day, amount, kind and repeat columns are for ledgers.
    ``summaries`` are customer columns that repeat a ledger measure: count,
    total, first or last.
    """

    key: str
    filename: str
    types: Mapping[str, T.DataType]
    id_column: str
    categories: Mapping[str, Sequence[str]] = field(default_factory=dict)
    ranges: Sequence[RangeRule] = ()
    flag_column: str | None = None
    day_column: str | None = None
    amount_column: str | None = None
    kind_column: str | None = None
    repeat_columns: Sequence[str] = ()
    summaries: Mapping[str, str] = field(default_factory=dict)
    expected_rows: int | None = None
    expected_bytes: int | None = None
    expected_fingerprint: str | None = None

    @property
    def columns(self) -> list[str]:
        return list(self.types)

    def text_schema(self) -> T.StructType:
        """All columns as text, the way they are read."""
        return T.StructType([T.StructField(name, TEXT) for name in self.types])

    def typed_schema(self) -> T.StructType:
        """All columns with their declared types."""
        return T.StructType([T.StructField(name, kind) for name, kind in self.types.items()])


@dataclass(frozen=True)
class LedgerColumns:
    """Names of the ledger columns the operators work on."""

    customer: str = "customer_id"
    day: str = "transaction_date"
    amount: str = "amount_cop"
    kind: str = "transaction_type"
    repeat_flag: str = "is_duplicate_looking"
    row_key: str = "transaction_row_id"
    repeat_keys: tuple[str, ...] = (
        "customer_id",
        "transaction_date",
        "amount_cop",
        "transaction_type",
    )

    @property
    def required(self) -> list[str]:
        return [self.customer, self.day, self.amount, self.kind, self.repeat_flag]


@dataclass(frozen=True)
class RecencyWindows:
    """The fixed date of an analysis and the windows that end on it."""

    analysis_date: date
    window_days: int = 90
    thresholds: tuple[int, ...] = (30, 60, 90)

    @property
    def recent_start(self) -> date:
        return self.analysis_date - timedelta(days=self.window_days - 1)

    @property
    def prior_end(self) -> date:
        return self.recent_start - timedelta(days=1)

    @property
    def prior_start(self) -> date:
        return self.analysis_date - timedelta(days=2 * self.window_days - 1)

    @property
    def recent_column(self) -> str:
        return f"transactions_recent_{self.window_days}d"

    @property
    def prior_column(self) -> str:
        return f"transactions_prior_{self.window_days}d"


# ---------------------------------------------------------------------------
# Fixed values of the retail-bank ledger.

BANK_WINDOWS = RecencyWindows(date(2023, 12, 29))
BANK_POPULATION = 30_460
BANK_SCENARIO_COUNTS = {30: 5_835, 60: 1_686, 90: 457}
BANK_OBSERVED = (date(2023, 1, 4), date(2023, 12, 29))

TRUE_FALSE = ("False", "True")
TRANSACTION_KINDS = ("Deposit", "Payment", "Transfer", "Withdrawal")

CUSTOMERS = SourceContract(
    key="customers",
    filename="customer_data.csv",
    id_column="customer_id",
    flag_column="credit_card",
    expected_rows=48_723,
    expected_bytes=23_519_477,
    types={
        "customer_id": BIGINT,
        "age": INTEGER,
        "gender": TEXT,
        "location": TEXT,
        "income_bracket": TEXT,
        "occupation": TEXT,
        "education_level": TEXT,
        "marital_status": TEXT,
        "household_size": INTEGER,
        "acquisition_channel": TEXT,
        "customer_segment": TEXT,
        "savings_account": BOOLEAN,
        "credit_card": BOOLEAN,
        "personal_loan": BOOLEAN,
        "investment_account": BOOLEAN,
        "insurance_product": BOOLEAN,
        "active_products": INTEGER,
        "app_logins_frequency": INTEGER,
        "feature_usage_diversity": INTEGER,
        "bill_payment_user": BOOLEAN,
        "auto_savings_enabled": BOOLEAN,
        "credit_utilization_ratio": DOUBLE,
        "international_transactions": INTEGER,
        "failed_transactions": INTEGER,
        "tx_count": INTEGER,
        "avg_tx_value": DOUBLE,
        "total_tx_volume": MONEY,
        "first_tx": DATE,
        "last_tx": DATE,
        "base_satisfaction": DOUBLE,
        "tx_satisfaction": DOUBLE,
        "product_satisfaction": DOUBLE,
        "satisfaction_score": INTEGER,
        "nps_score": INTEGER,
        "last_survey_date": DATE,
        "support_tickets_count": INTEGER,
        "resolved_tickets_ratio": DOUBLE,
        "app_store_rating": DOUBLE,
        "feedback_sentiment": TEXT,
        "feature_requests": TEXT,
        "complaint_topics": TEXT,
        "clv_segment": TEXT,
        "monthly_transaction_count": DOUBLE,
        "average_transaction_value": DOUBLE,
        "total_transaction_volume": MONEY,
        "transaction_frequency": DOUBLE,
        "last_transaction_date": DATE,
        "preferred_transaction_type": TEXT,
        "first_transaction_date": DATE,
        "weekend_transaction_ratio": DOUBLE,
        "avg_daily_transactions": DOUBLE,
        "customer_tenure": DOUBLE,
        "churn_probability": DOUBLE,
        "customer_lifetime_value": DOUBLE,
    },
    categories={
        "gender": ("Female", "Male", "Other"),
        "income_bracket": ("High", "Low", "Medium", "Very High"),
        "education_level": ("Bachelor", "High School", "Master", "PhD"),
        "marital_status": ("Divorced", "Married", "Single", "Widowed"),
        "acquisition_channel": ("Organic", "Paid Ad", "Partnership", "Referral"),
        "customer_segment": ("inactive", "occasional", "power", "regular"),
        "feedback_sentiment": ("Negative", "Neutral", "Positive"),
        "clv_segment": ("Bronze", "Gold", "Platinum", "Silver"),
        "preferred_transaction_type": TRANSACTION_KINDS,
        "savings_account": TRUE_FALSE,
        "credit_card": TRUE_FALSE,
        "personal_loan": TRUE_FALSE,
        "investment_account": TRUE_FALSE,
        "insurance_product": TRUE_FALSE,
        "bill_payment_user": TRUE_FALSE,
        "auto_savings_enabled": TRUE_FALSE,
    },
    # Summary columns and the ledger measure each repeats.
    summaries={
        "tx_count": "count",
        "total_tx_volume": "total",
        "total_transaction_volume": "total",
        "first_tx": "first",
        "first_transaction_date": "first",
        "last_tx": "last",
        "last_transaction_date": "last",
    },
    ranges=(
        RangeRule("age_outside_expected_range", "age", 18, 100),
        RangeRule("household_size_below_one", "household_size", low=1),
        RangeRule("negative_active_products", "active_products", low=0),
        RangeRule("negative_app_logins", "app_logins_frequency", low=0),
        RangeRule("negative_failed_transactions", "failed_transactions", low=0),
        RangeRule("credit_utilization_outside_zero_one", "credit_utilization_ratio", 0, 1),
        RangeRule("resolved_ticket_ratio_outside_zero_one", "resolved_tickets_ratio", 0, 1),
        RangeRule("weekend_ratio_outside_zero_one", "weekend_transaction_ratio", 0, 1),
        RangeRule("churn_probability_outside_zero_one", "churn_probability", 0, 1),
        RangeRule("nps_outside_expected_range", "nps_score", -100, 100),
        RangeRule("app_rating_outside_expected_range", "app_store_rating", 1, 5),
    ),
)

TRANSACTIONS = SourceContract(
    key="transactions",
    filename="transactions_data.csv",
    id_column="customer_id",
    expected_rows=3_159_157,
    expected_bytes=119_006_497,
    types={"customer_id": BIGINT, "date": DATE, "amount": MONEY, "type": TEXT},
    categories={"type": TRANSACTION_KINDS},
    day_column="date",
    amount_column="amount",
    kind_column="type",
    repeat_columns=("customer_id", "date", "amount", "type"),
)
