"""Summaries of the working relation.

Every summary starts from value counts: how many customers have each value of
a measure, per variant and recency band. That table is small however many
customers there are, it is built with partial aggregation, and exact quantiles
follow from it with the counts as weights.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.contracts import RecencyWindows
from tallywright.functions.frames import turn_to_rows
from tallywright.functions.numbers import (
    band_labels,
    count_where,
    percentage,
    recency_band,
    scenario_label,
)
from tallywright.operators.prefix import running_totals
from tallywright.operators.recency import CANONICAL, COLLAPSED
from tallywright.sources.scratch import stage

VARIANTS = (CANONICAL, COLLAPSED)


def value_counts(df: DataFrame, measures: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows per value of each measure: ``by`` columns, measure, value, n."""
    pairs = [
        F.struct(F.lit(name).alias("measure"), value.cast("bigint").alias("value"))
        for name, value in measures.items()
    ]
    return (
        df.select(*by, F.inline(F.array(*pairs)))
        .groupBy(*by, "measure", "value")
        .agg(F.count("*").alias("n"))
    )


def scenario_summary(variants: DataFrame, windows: RecencyWindows) -> DataFrame:
    """Measures of the customers above each recency threshold, per variant.

    ``variants`` holds the working relations told apart by ``data_variant``.
    Scenarios overlap: a customer above 90 days is also above 30. Bands do not,
    so customers are counted per band, and a scenario takes all bands above it.
    """
    counts = _band_counts(variants, windows, by=["data_variant"])
    rows = [
        _group_row(
            f"'{variant}' AS data_variant, '{scenario_label(threshold)}' AS scenario, "
            f"{threshold} AS threshold_days",
            everybody=f"data_variant = '{variant}'",
            inside=f"data_variant = '{variant}' AND band >= {ordinal}",
        )
        for variant in VARIANTS
        for ordinal, threshold in enumerate(windows.thresholds, start=1)
    ]
    # A row per variant and threshold whether or not anybody is in it.
    summary = counts.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return summary.select(
        "data_variant", "scenario", "threshold_days", *_group_columns(windows, with_counts=True)
    )


def scenario_change(summary: DataFrame, windows: RecencyWindows) -> DataFrame:
    """The scenario summary with differences from the canonical variant.

    Fails when a threshold has more than one canonical row to compare with.
    """
    same_threshold = W.partitionBy("threshold_days")
    canonical = F.col("data_variant") == CANONICAL

    def reference(column: str) -> Column:
        found = F.max(F.when(canonical, F.col(column))).over(same_threshold)
        single = F.count(F.when(canonical, 1)).over(same_threshold) <= 1
        return F.when(single, found).otherwise(
            F.raise_error(F.lit("a threshold has several canonical rows")).cast("double")
        )

    prior_median = f"{windows.prior_column}_median"
    change = F.col("customer_count") - reference("customer_count")
    return summary.select(
        *summary.columns,
        change.cast("bigint").alias("customer_count_change_vs_canonical"),
        F.round(F.col(prior_median) - reference(prior_median), 2).alias(
            "prior_median_change_vs_canonical"
        ),
    )


def scenario_relative_change(change: DataFrame, windows: RecencyWindows) -> DataFrame:
    """Changes against the canonical variant in percent of it; NULL where that is 0."""
    canonical_count = F.col("customer_count") - F.col("customer_count_change_vs_canonical")
    median, moved = F.col(f"{windows.prior_column}_median"), F.col("prior_median_change_vs_canonical")

    def relative(by: Column, of: Column) -> Column:
        return F.round(100 * by / F.nullif(of.cast("double"), F.lit(0.0)), 4)

    return change.select(
        "data_variant",
        "scenario",
        "threshold_days",
        relative(F.col("customer_count_change_vs_canonical"), canonical_count).alias(
            "customer_count_change_pct"
        ),
        relative(moved, F.round(median - moved, 2)).alias("prior_median_change_pct"),
    )


def order_scenarios(summary: DataFrame) -> DataFrame:
    """Scenario rows in report order: canonical first, then by threshold."""
    variant = F.when(F.col("data_variant") == CANONICAL, 0).otherwise(1)
    return summary.orderBy(variant, "threshold_days")


def band_summary(working: DataFrame, windows: RecencyWindows) -> DataFrame:
    """Measures per exclusive recency band, empty bands included."""
    counts = _band_counts(working, windows, by=[])
    rows = [
        _group_row(
            f"{ordinal} AS band_ordinal, '{label}' AS recency_band",
            everybody="true",
            inside=f"band = {ordinal}",
        )
        for ordinal, label in enumerate(band_labels(windows.thresholds))
    ]
    summary = counts.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return summary.select(
        "band_ordinal", "recency_band", *_group_columns(windows, with_counts=False)
    )


def recency_statistics(working: DataFrame) -> DataFrame:
    """Distribution of recency over all customers, one row."""
    counts = value_counts(working, {"recency": F.col("recency_days")})
    wanted = F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.9, 0.95)])
    stats = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("customer_count"),
        F.min("value").alias("minimum"),
        F.percentile("value", wanted, F.col("n")).alias("q"),
        F.max("value").alias("maximum"),
    )
    names = ("q1", "median", "q3", "p90", "p95")
    return stats.select(
        "customer_count",
        "minimum",
        *[F.round(F.col("q")[i], 2).alias(name) for i, name in enumerate(names)],
        "maximum",
    )


def trajectory_statistics(working: DataFrame, windows: RecencyWindows) -> DataFrame:
    """Recent against prior activity of customers with enough history, one row."""
    recent, prior = F.col(windows.recent_column), F.col(windows.prior_column)
    enough = F.col("sufficient_prior_history")
    measures = {"prior": prior, "recent": recent, "change": recent - prior}
    counts = value_counts(working, measures, by=["sufficient_prior_history"])
    change = F.col("measure") == "change"
    totals = counts.agg(
        _total(enough & change).alias("customer_count"),
        _total(~enough & change).alias("excluded_for_limited_history"),
        _total(enough & change & (F.col("value") < 0)).alias("lower_count"),
        _total(enough & change & (F.col("value") == 0)).alias("equal_count"),
        _total(enough & change & (F.col("value") > 0)).alias("higher_count"),
        *[
            F.percentile(
                F.when(enough & (F.col("measure") == name), F.col("value")), F.lit(0.5), F.col("n")
            ).alias(name)
            for name in measures
        ],
    )
    return totals.select(
        "customer_count",
        "excluded_for_limited_history",
        F.round("prior", 2).alias(f"prior_{windows.window_days}d_median"),
        F.round("recent", 2).alias(f"recent_{windows.window_days}d_median"),
        F.round("change", 2).alias("absolute_change_median"),
        *[
            column
            for name in ("lower", "equal", "higher")
            for column in (
                F.col(f"{name}_count"),
                percentage(F.col(f"{name}_count"), F.col("customer_count")).alias(f"{name}_pct"),
            )
        ],
    )


def pair_variants(canonical: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Two working relations side by side, for relations computed apart."""
    names = canonical.columns

    def side(df: DataFrame, variant: str) -> DataFrame:
        columns = [F.col(name).alias(f"{variant}_{name}") for name in names]
        return df.select("customer_id", *columns)

    def struct(variant: str) -> Column:
        return F.struct(*[F.col(f"{variant}_{name}").alias(name) for name in names]).alias(variant)

    merged = merge_one_to_one(
        side(canonical, "canonical"), side(collapsed, "collapsed"), "customer_id"
    )
    return merged.select("customer_id", struct("canonical"), struct("collapsed"))


def sensitivity_statistics(pair: DataFrame, windows: RecencyWindows) -> DataFrame:
    """What counting exact repeats once changes, one row."""
    days = windows.window_days

    def gone(column: str) -> Column:
        return F.col("canonical")[column] - F.col("collapsed")[column]

    full = gone("transactions_full_period")
    over = {
        (variant, threshold): count_where(F.col(variant)["recency_days"] > threshold)
        for variant in ("canonical", "collapsed")
        for threshold in windows.thresholds
    }
    changes = [
        F.abs(over["collapsed", threshold] - over["canonical", threshold])
        for threshold in windows.thresholds
    ]
    return pair.agg(
        F.coalesce(F.sum(full), F.lit(0)).alias("excess_rows_collapsed"),
        count_where(full > 0).alias("affected_customers"),
        F.max(full).alias("maximum_rows_collapsed_for_one_customer"),
        F.coalesce(F.sum(gone(windows.recent_column)), F.lit(0)).alias(
            f"recent_{days}d_rows_collapsed"
        ),
        F.coalesce(F.sum(gone(windows.prior_column)), F.lit(0)).alias(
            f"prior_{days}d_rows_collapsed"
        ),
        F.array_max(F.array(*changes)).alias("maximum_absolute_scenario_count_change"),
    )


def recency_ecdf(working: DataFrame) -> DataFrame:
    """Percent of customers at or below each recency value that occurs."""
    counts = working.groupBy("recency_days").agg(F.count("*").alias("customers"))
    totals, population = running_totals(counts, ["recency_days"], "customers", "at_or_below")
    return totals.select(
        "recency_days",
        "customers",
        "at_or_below",
        percentage(F.col("at_or_below"), F.lit(population)).alias("at_or_below_pct"),
    )


def activity_grid(working: DataFrame, windows: RecencyWindows, *, cells: int = 42) -> DataFrame:
    """Customers per cell of prior against recent activity.

    The axes end at the larger 99th percentile, rounded up. Customers beyond it
    are outside the grid; ``kept_pct`` tells how many are inside.
    """
    inside, cap, population = _activity_points(working, windows)

    def cell(name: str) -> Column:
        position = F.floor(F.col(name) * cells / F.nullif(cap, F.lit(0).cast("bigint")))
        return F.coalesce(F.least(position, F.lit(cells - 1)), F.lit(0)).cast("bigint")

    grid = inside.groupBy(
        cell("prior").alias("prior_cell"), cell("recent").alias("recent_cell")
    ).agg(F.sum("n").alias("customers"))
    return _with_share(grid, ["prior_cell", "recent_cell"], cap, population)


def activity_hexagons(working: DataFrame, windows: RecencyWindows, *, cells: int = 42) -> DataFrame:
    """Customers per hexagon of prior against recent activity.

    The axes are those of ``activity_grid``; ``cells`` hexagons with a point on top stand
    side by side along the first. A hexagon is named by its axial coordinates, ``column``
    along the first axis and ``row`` across, and by its centre in transactions.
    """
    inside, cap, population = _activity_points(working, windows)
    width = F.coalesce(F.nullif(cap, F.lit(0).cast("bigint")), F.lit(1).cast("bigint")).cast("double") / cells
    # Distances in hexagons: across a row is 1, from row to row the root of 3/4.
    along = F.col("prior").cast("double") / width
    across = F.col("recent").cast("double") / width / F.lit(math.sqrt(0.75))
    placed = inside.select("n", (along - across / 2).alias("x"), across.alias("z"))
    placed = placed.withColumn("y", -F.col("x") - F.col("z"))
    rounded = {name: F.floor(F.col(name) + 0.5).cast("bigint") for name in "xyz"}
    placed = placed.select("*", *[value.alias(f"r{name}") for name, value in rounded.items()])
    off = {name: F.abs(F.col(f"r{name}") - F.col(name)) for name in "xyz"}
    # The three coordinates add up to 0; the one rounded furthest follows from the others.
    column = F.when((off["x"] > off["y"]) & (off["x"] > off["z"]), -F.col("ry") - F.col("rz")).otherwise(F.col("rx"))
    row = F.when(
        ~((off["x"] > off["y"]) & (off["x"] > off["z"])) & (off["y"] <= off["z"]), -F.col("rx") - F.col("ry")
    ).otherwise(F.col("rz"))
    grid = placed.groupBy(column.alias("column"), row.alias("row")).agg(F.sum("n").alias("customers"))
    grid = grid.select(
        "*",
        F.round((F.col("column") + F.col("row") / 2) * width, 6).alias("prior_centre"),
        F.round(F.col("row") * F.lit(math.sqrt(0.75)) * width, 6).alias("recent_centre"),
    )
    return _with_share(grid, ["column", "row", "prior_centre", "recent_centre"], cap, population)


def _activity_points(working: DataFrame, windows: RecencyWindows) -> tuple[DataFrame, Column, int]:
    """Customers per point of prior and recent activity within the axes, their end, and all customers."""
    recent, prior = F.col(windows.recent_column), F.col(windows.prior_column)
    enough = working.filter(F.col("sufficient_prior_history"))
    points = enough.groupBy(prior.alias("prior"), recent.alias("recent")).agg(
        F.count("*").alias("n")
    )
    # The points are few next to the customers; written once, they give the
    # axes first and then the grid.
    points = stage(points, "activity_points")
    axes = points.agg(
        F.greatest(
            F.percentile("prior", F.lit(0.99), F.col("n")),
            F.percentile("recent", F.lit(0.99), F.col("n")),
        ).alias("limit"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("population"),
    ).first()
    cap = F.lit(None if axes["limit"] is None else math.ceil(axes["limit"])).cast("bigint")
    inside = points.filter((F.col("prior") <= cap) & (F.col("recent") <= cap))
    return inside, cap, axes["population"]


def _with_share(grid: DataFrame, names: Sequence[str], cap: Column, population: int) -> DataFrame:
    """Cells with the end of the axes and the share of customers that all cells hold."""
    kept = F.sum("customers").over(W.partitionBy())
    return grid.withColumn("kept", kept).select(
        *names,
        "customers",
        cap.alias("axis_cap"),
        percentage(F.col("kept"), F.lit(population)).alias("kept_pct"),
    )


def population_summary(working: DataFrame) -> DataFrame:
    """Grain and range of the working relation, one measure per row."""
    measured = working.agg(
        F.count("*").alias("rows"),
        F.countDistinct("customer_id").alias("ids"),
        F.min("recency_days").alias("low"),
        F.max("recency_days").alias("high"),
        count_where(~F.col("sufficient_prior_history")).alias("lacking"),
    )
    rows = {
        "Eligible customers": "rows",
        "Unique customer IDs": "ids",
        "Minimum recency (days)": "low",
        "Maximum recency (days)": "high",
        "Insufficient prior history": "lacking",
    }
    values = {label: F.col(name).cast("bigint") for label, name in rows.items()}
    return turn_to_rows(measured, values, "measure", "value")


def merge_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails when a key occurs twice on either side."""
    return _single(left, key).join(_single(right, key), key)


def _single(df: DataFrame, key: str) -> DataFrame:
    """One row per key; the key itself can't be had where it occurs twice.

    The join needs the key of every row of either side, so no rewriting of the plan can
    leave the check out, also for keys that match nothing.
    """
    rest = [name for name in df.columns if name != key]
    grouped = df.groupBy(key).agg(
        F.count("*").alias("copies"), *[F.first(name).alias(name) for name in rest]
    )
    single = F.when(F.col("copies") == 1, F.col(key)).otherwise(
        F.raise_error(F.lit("merge key is not unique")).cast(df.schema[key].dataType)
    )
    return grouped.select(single.alias(key), *rest)


def _band_counts(working: DataFrame, windows: RecencyWindows, by: Sequence[str]) -> DataFrame:
    banded = working.withColumn("band", recency_band(F.col("recency_days"), windows.thresholds))
    measures = {
        "prior": F.col(windows.prior_column),
        "full": F.col("transactions_full_period"),
        "months": F.col("active_months"),
        "lacks_history": (~F.col("sufficient_prior_history")).cast("int"),
    }
    return value_counts(banded, measures, by=[*by, "band"])


def _group_row(names: str, *, everybody: str, inside: str) -> Column:
    """One summary row as an aggregate over band counts, its names coming first."""
    prior = f"{inside} AND measure = 'prior'"
    return F.expr(
        f"""struct({names},
        coalesce(sum(n) FILTER (WHERE {everybody} AND measure = 'prior'), 0L) AS population,
        coalesce(sum(n) FILTER (WHERE {prior}), 0L) AS customers,
        percentile(value, array(0.25, 0.5, 0.75), n) FILTER (WHERE {prior}) AS prior,
        coalesce(sum(n) FILTER (WHERE {prior} AND value = 0), 0L) AS zero_prior,
        percentile(value, 0.5, n) FILTER (WHERE {inside} AND measure = 'full') AS full_median,
        percentile(value, 0.5, n) FILTER (WHERE {inside} AND measure = 'months') AS months_median,
        coalesce(sum(n) FILTER (
            WHERE {inside} AND measure = 'lacks_history' AND value = 1), 0L) AS lacking)"""
    )


def _group_columns(windows: RecencyWindows, *, with_counts: bool) -> list[Column]:
    customers, population = F.col("customers"), F.col("population")
    zero_prior, lacking = F.col("zero_prior"), F.col("lacking")
    prior, days = windows.prior_column, windows.window_days
    zero_count = [zero_prior.alias(f"zero_prior_{days}d_customers")] if with_counts else []
    lacking_count = [lacking.alias("insufficient_prior_history_customers")] if with_counts else []
    return [
        customers.alias("customer_count"),
        percentage(customers, population).alias("eligible_population_pct"),
        F.round(F.col("prior")[0], 2).alias(f"{prior}_q1"),
        F.round(F.col("prior")[1], 2).alias(f"{prior}_median"),
        F.round(F.col("prior")[2], 2).alias(f"{prior}_q3"),
        *zero_count,
        percentage(zero_prior, customers).alias(f"zero_prior_{days}d_pct"),
        F.round("full_median", 2).alias("transactions_full_period_median"),
        F.round("months_median", 2).alias("active_months_median"),
        *lacking_count,
        percentage(lacking, customers).alias("insufficient_prior_history_pct"),
    ]


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

