"""Measures of engagement per customer: several windows, values, mix, and segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.contracts import LedgerColumns, RecencyWindows
from tallywright.functions.numbers import count_where, percentage
from tallywright.operators.ranks import LISTED_ROWS, cut_points, group_number
from tallywright.operators.recency import only_eligible, stack_pair, working_relation_pair
from tallywright.sources.scratch import stage

#: Scores per measure.
SCORES = 5
UNSCORED = "Not scored"


@dataclass(frozen=True)
class Segment:
    """A segment by the lowest and highest score of each measure it takes; ends included."""

    name: str
    recency: tuple[int, int] = (1, SCORES)
    frequency: tuple[int, int] = (1, SCORES)
    value: tuple[int, int] = (1, SCORES)


#: The first segment that takes a customer is theirs.
SEGMENTS = (
    Segment("Highly engaged", recency=(4, 5), frequency=(4, 5)),
    Segment("Lapsing regulars", recency=(1, 2), frequency=(4, 5)),
    Segment("Recent but infrequent", recency=(4, 5), frequency=(1, 2)),
    Segment("Dormant, of value", recency=(1, 2), frequency=(1, 3), value=(4, 5)),
    Segment("Dormant", recency=(1, 2), frequency=(1, 3)),
    Segment("Moderately engaged"),
)


def recency_windows(
    ledger: DataFrame,
    customers: DataFrame,
    analysis_date: date,
    windows: Sequence[int] = (30, 60, 90),
    *,
    columns: LedgerColumns = LedgerColumns(),
    eligible: Column,
    customer_key: str = "customer_id",
) -> DataFrame:
    """Rows per customer in each recent window and in the window of equal length before it.

    All windows come from one pass. Their first days cut the calendar into spans, the
    rows of a customer are counted per span, and the rows from one border to another
    are the difference of the running totals at both. ``sufficient_history_<n>d`` tells
    whether a customer was there on the first day of the earlier window.
    """
    spans = [RecencyWindows(analysis_date, days) for days in windows]
    end = analysis_date + timedelta(days=1)
    borders = sorted({end, *(w.recent_start for w in spans), *(w.prior_start for w in spans)})
    day = F.to_date(columns.day)
    span = F.lit(None).cast("int")
    for number, (start, stop) in enumerate(zip(borders, borders[1:])):
        span = F.when((day >= F.lit(start)) & (day < F.lit(stop)), number).otherwise(span)
    rows = ledger.select(F.col(columns.customer).alias("customer_id"), day.alias("day"), span.alias("span"))
    histogram = rows.groupBy("customer_id").agg(
        F.min("day").alias("first_day"),
        F.count("*").alias("rows"),
        *[count_where(F.col("span") == number).alias(f"span_{number}") for number in range(len(borders) - 1)],
    )

    def until(border: date) -> Column:
        counts = [F.col(f"span_{number}") for number in range(borders.index(border))]
        return reduce(lambda a, b: a + b, counts, F.lit(0).cast("bigint"))

    measures = [
        column
        for w in spans
        for column in (
            (until(end) - until(w.recent_start)).alias(w.recent_column),
            (until(w.recent_start) - until(w.prior_start)).alias(w.prior_column),
            (F.col("first_day") <= F.lit(w.prior_start)).alias(f"sufficient_history_{w.window_days}d"),
        )
    ]
    return only_eligible(histogram, customers, eligible, customer_key).select(
        "customer_id", F.col("rows").alias("transactions_full_period"), *measures
    )


def value_measures(
    ledger: DataFrame,
    customers: DataFrame,
    windows: RecencyWindows,
    *,
    columns: LedgerColumns = LedgerColumns(),
    eligible: Column,
    customer_key: str = "customer_id",
) -> DataFrame:
    """Counts, exact amounts and their mean per customer and variant, from one pass over the ledger.

    A sum of more than 38 digits is NULL, and so is the mean of nothing.
    """
    pair = working_relation_pair(
        ledger,
        customers,
        windows,
        columns=columns,
        eligible=eligible,
        customer_key=customer_key,
        values=True,
    )
    days = windows.window_days
    rows = stack_pair(pair)
    recent, prior = F.col(f"amount_recent_{days}d"), F.col(f"amount_prior_{days}d")
    full = F.col("amount_full_period")

    def mean(amount: Column, rows_column: str) -> Column:
        rows = F.nullif(F.col(rows_column), F.lit(0).cast("bigint"))
        return amount.cast("double") / rows

    return rows.select(
        "data_variant",
        "customer_id",
        "transactions_full_period",
        windows.recent_column,
        windows.prior_column,
        full.alias("amount_full_period"),
        recent,
        prior,
        F.try_subtract(recent, prior).alias("amount_change"),
        mean(full, "transactions_full_period").alias("mean_amount_full_period"),
        mean(recent, windows.recent_column).alias(f"mean_amount_recent_{days}d"),
    )


def transaction_mix(
    ledger: DataFrame,
    customers: DataFrame,
    kinds: Sequence[str],
    *,
    columns: LedgerColumns = LedgerColumns(),
    eligible: Column,
    customer_key: str = "customer_id",
) -> DataFrame:
    """How the rows of each customer divide among transaction types.

    Gives rows and percent of every listed type and of all others (NULL among them),
    the number of types met, the most frequent one (ties to the first by name; NULL only
    where there is no other), and the entropy in bits: 0 for a single type.

    Rows are first counted per customer and type, so a customer of very many rows is one
    row per type and task from there on, however many types there are.
    """
    counted = ledger.groupBy(
        F.col(columns.customer).alias("customer_id"), F.col(columns.kind).alias("kind")
    ).agg(F.count("*").alias("n"))
    listed = F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False))
    n = F.col("n").cast("double")
    names = {kind: f"kind_{number}" for number, kind in enumerate(kinds)}
    mixed = counted.groupBy("customer_id").agg(
        F.sum("n").alias("transactions"),
        F.count("*").alias("types"),
        F.min(F.struct(F.col("kind").isNull().alias("unnamed"), (-F.col("n")).alias("less"), "kind")).alias("top"),
        F.sum(n * F.log2(n)).alias("weighted"),
        *[
            F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(name)
            for kind, name in names.items()
        ],
        F.coalesce(F.sum(F.when(~listed, F.col("n"))), F.lit(0)).alias("others"),
    )
    total = F.col("transactions")
    shares = [
        column
        for kind, name in [*names.items(), ("other", "others")]
        for column in (
            F.col(name).alias(f"transactions_{kind.lower()}"),
            percentage(F.col(name), total).alias(f"{kind.lower()}_pct"),
        )
    ]
    entropy = F.log2(total.cast("double")) - F.col("weighted") / total
    return only_eligible(mixed, customers, eligible, customer_key).select(
        "customer_id",
        "transactions",
        *shares,
        "types",
        F.col("top.kind").alias("top_type"),
        (-F.col("top.less")).alias("top_type_transactions"),
        percentage(-F.col("top.less"), total).alias("top_type_pct"),
        F.abs(F.round(entropy, 6)).alias("entropy_bits"),
    )


def engagement_segments(
    measures: DataFrame,
    *,
    recency: str = "recency_days",
    frequency: str = "transactions_full_period",
    value: str = "amount_full_period",
    scores: int = SCORES,
    segments: Sequence[Segment] = SEGMENTS,
    listed_rows: int = LISTED_ROWS,
) -> DataFrame:
    """Score every customer by recency, frequency and value, and name their segment.

    A score from 1 to ``scores`` tells in which group of equal size a customer is, the
    best having the highest: few days, many transactions, much value. Customers of equal
    value share a score, that of the first of them. A customer who lacks a measure has
    no score for it and is in no segment.

    Scores need order statistics only: a few values of each measure, found by counting,
    which become literals of one last pass. So customers are neither sorted nor brought
    to one task, and the result doesn't depend on how they are dealt.
    """
    known = stage(measures.select("customer_id", recency, frequency, value), "engagement")
    scored = known
    for name, column, low_is_best in (
        ("recency_score", recency, True),
        ("frequency_score", frequency, False),
        ("value_score", value, False),
    ):
        points = cut_points(known, column, scores, highest_first=low_is_best, listed_rows=listed_rows)
        scored = scored.withColumn(name, group_number(F.col(column), points, highest_first=low_is_best))
    return scored.withColumn("segment", _segment(segments))


def _segment(segments: Sequence[Segment]) -> Column:
    named = F.lit(UNSCORED)
    for segment in reversed(segments):
        inside = (
            F.col("recency_score").between(*segment.recency)
            & F.col("frequency_score").between(*segment.frequency)
            & F.col("value_score").between(*segment.value)
        )
        named = F.when(inside, segment.name).otherwise(named)
    return named


def segment_summary(
    segmented: DataFrame,
    *,
    recency: str = "recency_days",
    frequency: str = "transactions_full_period",
    value: str = "amount_full_period",
) -> DataFrame:
    """Customers of each segment, their share, ends of recency and frequency, and their value."""
    scale = getattr(segmented.schema[value].dataType, "scale", 0)
    amount = F.col(value).cast(f"decimal(38,{scale})")
    counted = segmented.groupBy("segment").agg(
        F.count("*").alias("customers"),
        F.min(recency).alias("least_recency_days"),
        F.max(recency).alias("most_recency_days"),
        F.sum(frequency).alias("transactions"),
        F.try_sum(amount).alias("amount"),
    )
    everybody = W.partitionBy()  # of one row per segment
    return counted.select(
        "segment",
        "customers",
        percentage(F.col("customers"), F.sum("customers").over(everybody)).alias("customers_pct"),
        "least_recency_days",
        "most_recency_days",
        "transactions",
        percentage(F.col("transactions"), F.sum("transactions").over(everybody)).alias("transactions_pct"),
        "amount",
    )


def segment_profile(
    segmented: DataFrame,
    customers: DataFrame,
    characteristics: Mapping[str, Column],
    *,
    customer_key: str = "customer_id",
) -> DataFrame:
    """How the customers of each segment divide among the values of some characteristics.

    A row per segment, characteristic and value, with its customers and their percent of
    the segment. A customer listed many times counts once, with the smallest value.
    """
    listed = customers.groupBy(F.col(customer_key).alias("customer_id")).agg(
        *[F.min(value.cast("string")).alias(f"c{at}") for at, value in enumerate(characteristics.values())]
    )
    pairs = [
        F.struct(F.lit(name).alias("characteristic"), F.col(f"c{at}").alias("value"))
        for at, name in enumerate(characteristics)
    ]
    counted = (
        segmented.select("customer_id", "segment")
        .join(listed, "customer_id", "left")
        .select("segment", F.inline(F.array(*pairs)))
        .groupBy("segment", "characteristic", "value")
        .agg(F.count("*").alias("customers"))
    )
    # The counts are few next to the customers, so they are added up again.
    whole = counted.groupBy("segment", "characteristic").agg(F.sum("customers").alias("of"))
    return counted.join(whole, ["segment", "characteristic"]).select(
        "segment",
        "characteristic",
        "value",
        "customers",
        percentage(F.col("customers"), F.col("of")).alias("customers_pct"),
    )
