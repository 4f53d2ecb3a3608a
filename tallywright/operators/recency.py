"""Per-customer recency and activity: the working relation and its contract."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.contracts import LedgerColumns, RecencyWindows
from tallywright.functions.dates import days_between, days_inclusive, month_start
from tallywright.functions.frames import turn_to_rows
from tallywright.functions.numbers import count_where

# Active months are kept as bits of up to so many numbers per customer.
MONTHS_PER_WORD = 64
MONTH_WORDS = 4
# Rows that one task groups by their repeat keys; its memory grows with them and with nothing else.
TASK_ROWS = 1_000_000
# So many eligible customers are broadcast to the ledger.
FEW_CUSTOMERS = 250_000

CANONICAL = "canonical"
COLLAPSED = "exact_groups_collapsed"


def working_columns(windows: RecencyWindows) -> list[str]:
    """Columns of the working relation, in order."""
    return [
        "customer_id",
        "first_transaction_date",
        "last_transaction_date",
        "observed_days",
        "recency_days",
        "transactions_full_period",
        windows.recent_column,
        windows.prior_column,
        "active_months",
        "sufficient_prior_history",
    ]


def working_relation(
    ledger: DataFrame,
    customers: DataFrame,
    windows: RecencyWindows,
    *,
    columns: LedgerColumns = LedgerColumns(),
    eligible: Column,
    customer_key: str = "customer_id",
) -> DataFrame:
    """One row per eligible customer with rows in the ledger.

    Ledger rows are reduced to customers before anything is joined, with most of
    the work done where the rows are: a customer with very many rows is one row
    per task from there on.
    """
    rows = ledger.select(
        F.col(columns.customer).alias("customer_id"), F.to_date(columns.day).alias("day")
    )
    counts = {
        "full_rows": F.count("*"),
        "recent_rows": count_where(_in_recent(windows)),
        "prior_rows": count_where(_in_prior(windows)),
    }
    first, last, _ = _observed(rows)
    activity = _by_customer(rows, counts, (first, last))
    return only_eligible(activity, customers, eligible, customer_key).select(
        *_measures(windows, "full_rows", "recent_rows", "prior_rows")
    )


def collapsed_working_relation(
    ledger: DataFrame,
    customers: DataFrame,
    windows: RecencyWindows,
    *,
    columns: LedgerColumns = LedgerColumns(),
    eligible: Column,
    customer_key: str = "customer_id",
) -> DataFrame:
    """The working relation with exact repeats counted once."""
    day = F.to_date(columns.day).alias("day")
    first, last, size = _observed(ledger.select(day))
    groups = _in_ranges(ledger.select(*columns.repeat_keys), size).distinct()
    counts = {
        "full_groups": F.count("*"),
        "recent_groups": count_where(_in_recent(windows)),
        "prior_groups": count_where(_in_prior(windows)),
    }
    rows = groups.select(F.col(columns.customer).alias("customer_id"), day)
    activity = _by_customer(rows, counts, (first, last))
    return only_eligible(activity, customers, eligible, customer_key).select(
        *_measures(windows, "full_groups", "recent_groups", "prior_groups")
    )


def distinct_events(ledger: DataFrame, columns: LedgerColumns = LedgerColumns()) -> DataFrame:
    """One row per distinct combination of the repeat keys."""
    return _in_ranges(ledger.select(*columns.repeat_keys), ledger.count()).distinct()


def working_relation_pair(
    ledger: DataFrame,
    customers: DataFrame,
    windows: RecencyWindows,
    *,
    columns: LedgerColumns = LedgerColumns(),
    eligible: Column,
    customer_key: str = "customer_id",
    values: bool = False,
) -> DataFrame:
    """Both variants side by side from one pass over the ledger.

    Gives ``customer_id`` and one struct per variant. Each exact group is
    counted once; the canonical measures add up the group sizes and the
    collapsed ones count the groups.

    With ``values`` the amounts of the whole period and of both windows come along, as
    exact decimals: copies times the amount, and the amount once. The amount must be
    one of the repeat keys then. A NULL amount adds nothing; a sum of more than 38 digits
    is NULL.
    """
    if values and columns.amount not in columns.repeat_keys:
        raise ValueError("rows that repeat must agree in their amount for it to count once")
    day = F.to_date(columns.day).alias("day")
    amounts = [F.col(columns.amount).alias("amount")] if values else []
    first, last, size = _observed(ledger.select(day))
    groups = (
        _in_ranges(ledger.select(*columns.repeat_keys), size)
        .groupBy(*columns.repeat_keys)
        .agg(F.count("*").alias("copies"))
        .select(F.col(columns.customer).alias("customer_id"), day, "copies", *amounts)
    )
    recent, prior = _in_recent(windows), _in_prior(windows)
    counts = {
        "full_rows": F.sum("copies"),
        "recent_rows": F.sum(F.when(recent, F.col("copies")).otherwise(0)),
        "prior_rows": F.sum(F.when(prior, F.col("copies")).otherwise(0)),
        "full_groups": F.count("*"),
        "recent_groups": count_where(recent),
        "prior_groups": count_where(prior),
    }
    sums = _value_sums(ledger, columns, windows) if values else {}
    activity = _by_customer(groups, counts | sums, (first, last))
    return only_eligible(activity, customers, eligible, customer_key).select(
        "customer_id",
        F.struct(
            *_measures(windows, "full_rows", "recent_rows", "prior_rows"),
            *_values(windows, "rows", values),
        ).alias("canonical"),
        F.struct(
            *_measures(windows, "full_groups", "recent_groups", "prior_groups"),
            *_values(windows, "groups", values),
        ).alias("collapsed"),
    )


def split_pair(pair: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The canonical and the collapsed working relation of a pair."""
    return pair.select("canonical.*"), pair.select("collapsed.*")


def stack_pair(pair: DataFrame) -> DataFrame:
    """Both variants of a pair as rows, told apart by ``data_variant``."""
    names = pair.select("canonical.*").columns

    def variant(struct: str, label: str) -> Column:
        fields = [F.col(struct)[name].alias(name) for name in names]
        return F.struct(F.lit(label).alias("data_variant"), *fields)

    return pair.select(
        F.inline(F.array(variant("canonical", CANONICAL), variant("collapsed", COLLAPSED)))
    )


def stack_variants(canonical: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Two working relations as rows, told apart by ``data_variant``."""
    return canonical.withColumn("data_variant", F.lit(CANONICAL)).unionByName(
        collapsed.withColumn("data_variant", F.lit(COLLAPSED))
    )


def contract_violations(
    working: DataFrame,
    windows: RecencyWindows,
    *,
    expected_population: int | None = None,
    expected_scenario_counts: Mapping[int, int] | None = None,
) -> DataFrame:
    """Violations per rule of the working relation; all zero when it holds."""
    missing = sorted(set(working_columns(windows)) - set(working.columns))
    if missing:
        raise ValueError(f"working relation lacks the columns {missing}")

    first, last = F.col("first_transaction_date"), F.col("last_transaction_date")
    full = F.col("transactions_full_period")
    recent, prior = F.col(windows.recent_column), F.col(windows.prior_column)
    analysis = F.lit(windows.analysis_date)
    durations = ["observed_days", "recency_days", "transactions_full_period"]
    durations += [windows.recent_column, windows.prior_column, "active_months"]
    rules = {
        "null_customer_id": F.col("customer_id").isNull(),
        "null_required_value": _either([F.col(name).isNull() for name in working_columns(windows)]),
        "date_order": (first > last) | (last > analysis),
        "observed_days_mismatch": ~F.col("observed_days").eqNullSafe(
            days_inclusive(first, analysis)
        ),
        "recency_days_mismatch": ~F.col("recency_days").eqNullSafe(days_between(last, analysis)),
        "negative_value": _either([F.col(name) < 0 for name in durations]),
        "recent_exceeds_full": recent > full,
        "prior_exceeds_full": prior > full,
        "windows_exceed_full": recent + prior > full,
    }
    measured = working.agg(
        F.count("*").alias("population"),
        F.countDistinct("customer_id").alias("distinct_ids"),
        *[count_where(rule).alias(name) for name, rule in rules.items()],
        *[
            count_where(F.col("recency_days") > threshold).alias(f"over_{threshold}")
            for threshold in expected_scenario_counts or {}
        ],
    )
    found = [(name, F.col(name)) for name in rules]
    repeated = F.col("population") - F.col("null_customer_id") - F.col("distinct_ids")
    found.insert(1, ("duplicate_customer_id", repeated))
    if expected_population is not None:
        found.insert(0, ("population", F.abs(F.col("population") - expected_population)))
    for threshold, count in (expected_scenario_counts or {}).items():
        off = F.abs(F.col(f"over_{threshold}") - count)
        found.append((f"scenario_count_{threshold}", off))
    values = {name: value.cast("bigint") for name, value in found}
    return turn_to_rows(measured, values, "rule", "violations")


def grain_difference(canonical: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Customers found in one variant only, and customers whose recency differs."""
    left = canonical.select(
        "customer_id", F.col("recency_days").alias("left_days"), F.lit(True).alias("on_left")
    )
    right = collapsed.select(
        "customer_id", F.col("recency_days").alias("right_days"), F.lit(True).alias("on_right")
    )
    both = F.col("on_left").isNotNull() & F.col("on_right").isNotNull()
    return left.join(right, "customer_id", "full_outer").agg(
        count_where(F.col("on_right").isNull()).alias("only_canonical"),
        count_where(F.col("on_left").isNull()).alias("only_collapsed"),
        count_where(both & ~F.col("left_days").eqNullSafe(F.col("right_days"))).alias(
            "recency_differs"
        ),
    )


def _in_recent(windows: RecencyWindows) -> Column:
    return F.col("day").between(F.lit(windows.recent_start), F.lit(windows.analysis_date))


def _in_prior(windows: RecencyWindows) -> Column:
    return F.col("day").between(F.lit(windows.prior_start), F.lit(windows.prior_end))


def _observed(rows: DataFrame) -> tuple[int, int, int]:
    """Numbers of a ledger's first and last month, and of its rows: a scan of one column, no shuffle."""
    ends = rows.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("size"))
    months = [F.year(name) * 12 + F.month(name) for name in ("first", "last")]
    found = ends.select(*months, "size").first()
    return (found[0] or 0, found[1] or 0, found[2])


def _in_ranges(rows: DataFrame, size: int) -> DataFrame:
    """Rows dealt to ranges of all their columns, so many that each is a task of bounded memory.

    Equal rows share a range, so grouping by all columns shuffles nothing more. The ranges
    are balanced by their rows, whatever the number of shuffle partitions: a customer of very
    many rows is cut into several by the other columns, and all others lie in one range or
    two, where their groups become one row. A short ledger is left as it is.
    """
    if size <= TASK_ROWS:
        return rows
    ranges = max(-(-size // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(ranges, *rows.columns)


def _value_sums(
    ledger: DataFrame, columns: LedgerColumns, windows: RecencyWindows
) -> dict[str, Column]:
    """Amounts of the whole period and of both windows, every copy counted and groups once."""
    scale = getattr(ledger.schema[columns.amount].dataType, "scale", 0)
    once = F.col("amount").cast(f"decimal(38,{scale})")
    every = F.try_multiply(once, F.col("copies")).cast(f"decimal(38,{scale})")
    spans = {"full": F.lit(True), "recent": _in_recent(windows), "prior": _in_prior(windows)}
    return {
        f"{span}_{kind}_value": _bounded_sum(F.when(inside, once), F.when(inside, amount), scale)
        for span, inside in spans.items()
        for kind, amount in (("rows", every), ("groups", once))
    }


def _bounded_sum(known: Column, value: Column, scale: int) -> Column:
    """The sum as a decimal of 38 digits, 0 of nothing, NULL where it or a value has more digits."""
    zero = F.lit(0).cast(f"decimal(38,{scale})")
    total = F.when(F.count(known) == F.count(value), F.try_sum(value))
    return F.when(F.count(known) == 0, zero).otherwise(total)


def _values(windows: RecencyWindows, kind: str, wanted: bool) -> list[Column]:
    names = {
        "full": "amount_full_period",
        "recent": f"amount_recent_{windows.window_days}d",
        "prior": f"amount_prior_{windows.window_days}d",
    }
    return [F.col(f"{span}_{kind}_value").alias(name) for span, name in names.items() if wanted]


def _by_customer(
    rows: DataFrame, counts: Mapping[str, Column], observed: tuple[int, int]
) -> DataFrame:
    """First and last day, counts and active months per customer.

    Months are marked as bits, 64 to a number, so one aggregation does it all.
    Ledgers that span more months than fit are reduced to months first.
    """
    ends = [F.min("day").alias("first_day"), F.max("day").alias("last_day")]
    counted = [value.alias(name) for name, value in counts.items()]
    first, last = observed
    words = (last - first) // MONTHS_PER_WORD + 1
    if words > MONTH_WORDS:
        months = rows.groupBy("customer_id", month_start(F.col("day")).alias("month"))
        return (
            months.agg(*ends, *counted)
            .groupBy("customer_id")
            .agg(
                F.min("first_day").alias("first_day"),
                F.max("last_day").alias("last_day"),
                *[F.try_sum(name).alias(name) for name in counts],
                F.count("month").alias("active_months"),
            )
        )

    place = (F.year("day") * 12 + F.month("day") - first).alias("place")
    marks = [
        F.expr(
            f"bit_or(CASE WHEN place DIV {MONTHS_PER_WORD} = {word} "
            f"THEN shiftleft(1L, CAST(place % {MONTHS_PER_WORD} AS INT)) END)"
        ).alias(f"months_{word}")
        for word in range(words)
    ]
    marked = [F.coalesce(F.bit_count(f"months_{word}"), F.lit(0)) for word in range(words)]
    active = reduce(lambda a, b: a + b, marked).cast("bigint")
    activity = rows.select("*", place).groupBy("customer_id").agg(*ends, *counted, *marks)
    return activity.select(
        "customer_id", "first_day", "last_day", *counts, active.alias("active_months")
    )


def _either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def only_eligible(
    activity: DataFrame, customers: DataFrame, eligible: Column, customer_key: str
) -> DataFrame:
    """Rows of eligible customers; ``activity`` has one per customer.

    The number of eligible customers is measured. Few are broadcast, and the optimizer
    moves that semi join below the aggregation. Otherwise the customers are joined once
    aggregated: an inner join stays there, where a semi join may be moved down to the
    ledger by an estimate and then shuffle and sort it by customer.
    """
    found = customers.filter(eligible).select(F.col(customer_key).alias("customer_id"))
    # A customer listed many times is one row before the join.
    keys = found.distinct()
    if found.count() <= FEW_CUSTOMERS:
        return activity.join(F.broadcast(keys), "customer_id", "left_semi")
    return activity.join(keys, "customer_id")


def _measures(windows: RecencyWindows, full: str, recent: str, prior: str) -> list[Column]:
    analysis = F.lit(windows.analysis_date)
    first, last = F.col("first_day"), F.col("last_day")
    return [
        F.col("customer_id"),
        first.alias("first_transaction_date"),
        last.alias("last_transaction_date"),
        days_inclusive(first, analysis).alias("observed_days"),
        days_between(last, analysis).alias("recency_days"),
        F.col(full).alias("transactions_full_period"),
        F.col(recent).alias(windows.recent_column),
        F.col(prior).alias(windows.prior_column),
        F.col("active_months"),
        (first <= F.lit(windows.prior_start)).alias("sufficient_prior_history"),
    ]
