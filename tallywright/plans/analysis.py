"""The whole recency analysis: working relations, their gates, and all summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.contracts import BANK_WINDOWS, TRANSACTION_KINDS, LedgerColumns, RecencyWindows
from tallywright.operators import engagement, recency, summaries
from tallywright.sources.reports import json_ready, write_summary_csv
from tallywright.sources.scratch import stage


class AnalysisError(ValueError):
    """A working relation that breaks its contract."""


@dataclass(frozen=True)
class Analysis:
    """Working relations and summaries of one analysis."""

    canonical: DataFrame
    collapsed: DataFrame
    summaries: Mapping[str, DataFrame]


def run_analysis(
    ledger: DataFrame,
    customers: DataFrame,
    windows: RecencyWindows = BANK_WINDOWS,
    *,
    eligible: Column | None = None,
    columns: LedgerColumns = LedgerColumns(),
    customer_key: str = "customer_id",
    expected_population: int | None = None,
    expected_scenario_counts: Mapping[int, int] | None = None,
) -> Analysis:
    """Compute both variants in one pass, check them, and summarise them.

    The working relations are written to scratch once: one row per customer,
    from which every gate and summary is a short job. Credit-card holders are
    eligible unless another condition is given.
    """
    pair = stage(
        recency.working_relation_pair(
            ledger,
            customers,
            windows,
            columns=columns,
            eligible=F.col("credit_card") if eligible is None else eligible,
            customer_key=customer_key,
        ),
        "working_relations",
    )
    canonical, collapsed = recency.split_pair(pair)
    for variant, relation in ((recency.CANONICAL, canonical), (recency.COLLAPSED, collapsed)):
        found = recency.contract_violations(
            relation,
            windows,
            expected_population=expected_population,
            expected_scenario_counts=expected_scenario_counts,
        ).filter("violations > 0")
        broken = [row["rule"] for row in found.collect()]
        if broken:
            raise AnalysisError(f"the {variant} relation breaks {', '.join(broken)}")
    differences = recency.grain_difference(canonical, collapsed).first()
    if any(differences):
        raise AnalysisError(f"the variants differ in customers or recency: {differences}")

    scenarios = summaries.scenario_summary(recency.stack_pair(pair), windows)
    change = summaries.scenario_change(scenarios, windows)
    return Analysis(
        canonical,
        collapsed,
        {
            "scenarios": change,
            "relative_change": summaries.scenario_relative_change(change, windows),
            "bands": summaries.band_summary(canonical, windows),
            "recency": summaries.recency_statistics(canonical),
            "trajectory": summaries.trajectory_statistics(canonical, windows),
            "sensitivity": summaries.sensitivity_statistics(pair, windows),
            "ecdf": summaries.recency_ecdf(canonical),
            "activity_grid": summaries.activity_grid(canonical, windows),
            "population": summaries.population_summary(canonical),
        },
    )


def run_engagement(
    ledger: DataFrame,
    customers: DataFrame,
    windows: RecencyWindows = BANK_WINDOWS,
    *,
    eligible: Column | None = None,
    columns: LedgerColumns = LedgerColumns(),
    customer_key: str = "customer_id",
    kinds: Sequence[str] = TRANSACTION_KINDS,
    characteristics: Mapping[str, Column] | None = None,
) -> Mapping[str, DataFrame]:
    """Segments of the customers by recency, frequency and value, and what tells them apart.

    Gives the segmented customers, a summary of the segments, the mix of types and the
    rows in several windows per customer, and how each segment divides among
    ``characteristics`` of the customers where some are given. Customers of the canonical
    ledger are scored: repeats count as often as they occur.
    """
    who = {
        "customers": customers,
        "columns": columns,
        "eligible": F.col("credit_card") if eligible is None else eligible,
        "customer_key": customer_key,
    }
    pair = recency.working_relation_pair(ledger, windows=windows, values=True, **who)
    segmented = stage(engagement.engagement_segments(recency.split_pair(pair)[0]), "segments")
    found = {
        "segments": segmented,
        "summary": engagement.segment_summary(segmented),
        "mix": engagement.transaction_mix(ledger, kinds=kinds, **who),
        "windows": engagement.recency_windows(
            ledger, analysis_date=windows.analysis_date, windows=windows.thresholds, **who
        ),
    }
    if characteristics:
        found["profile"] = engagement.segment_profile(
            segmented, customers, characteristics, customer_key=customer_key
        )
    return found


def write_analysis(analysis: Analysis, path: str) -> None:
    """Write relations as Parquet by customer, scenarios as CSV, the rest as JSON."""
    relations = {"canonical": analysis.canonical, "collapsed": analysis.collapsed}
    for name, relation in relations.items():
        relation.orderBy("customer_id").write.parquet(f"{path}/{name}")
    for name, summary in analysis.summaries.items():
        if name in ("scenarios", "relative_change"):
            write_summary_csv(summary, f"{path}/{name}", ["data_variant", "threshold_days"])
        else:
            json_ready(summary).write.json(f"{path}/{name}")
