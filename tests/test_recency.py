from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from bank import WORKING_ROWS, working
from pyspark.sql import functions as F

from tallywright.contracts import BANK_WINDOWS, RecencyWindows
from tallywright.operators import recency, summaries
from tallywright.plans.analysis import AnalysisError, run_analysis, write_analysis


def changed(row, **values):
    names = recency.working_columns(BANK_WINDOWS)
    record = dict(zip(names, row, strict=True)) | values
    return tuple(record[name] for name in names)


def violations(df, **expected):
    found = recency.contract_violations(df, BANK_WINDOWS, **expected).collect()
    return {row["rule"]: row["violations"] for row in found if row["violations"]}


def one(df):
    return df.first().asDict()


def test_windows_end_on_the_analysis_date():
    assert BANK_WINDOWS.recent_start == date(2023, 10, 1)
    assert BANK_WINDOWS.prior_end == date(2023, 9, 30)
    assert BANK_WINDOWS.prior_start == date(2023, 7, 3)
    assert RecencyWindows(date(2024, 1, 30), 7).recent_column == "transactions_recent_7d"


def test_contract_holds(spark):
    found = violations(
        working(spark), expected_population=4, expected_scenario_counts={30: 3, 60: 2, 90: 1}
    )
    assert found == {}


@pytest.mark.parametrize(
    ("values", "rule"),
    [
        ({"customer_id": 101}, "duplicate_customer_id"),
        ({"customer_id": None}, "null_customer_id"),
        ({"active_months": None}, "null_required_value"),
        ({"first_transaction_date": date(2023, 12, 1)}, "date_order"),
        ({"last_transaction_date": date(2024, 1, 1)}, "date_order"),
        ({"observed_days": 331}, "observed_days_mismatch"),
        ({"recency_days": 41}, "recency_days_mismatch"),
        ({"transactions_prior_90d": -1}, "negative_value"),
        ({"transactions_recent_90d": 16}, "recent_exceeds_full"),
        ({"transactions_prior_90d": 16}, "prior_exceeds_full"),
        ({"transactions_prior_90d": 13}, "windows_exceed_full"),
    ],
)
def test_contract_breaks(spark, values, rule):
    rows = [WORKING_ROWS[0], changed(WORKING_ROWS[1], **values), *WORKING_ROWS[2:]]
    assert rule in violations(working(spark, rows))


def test_contract_expectations(spark):
    found = violations(
        working(spark), expected_population=5, expected_scenario_counts={30: 3, 90: 3}
    )
    assert found == {"population": 1, "scenario_count_90": 2}


def test_contract_missing_column(spark):
    with pytest.raises(ValueError, match="active_months"):
        recency.contract_violations(working(spark).drop("active_months"), BANK_WINDOWS)


def test_scenarios_and_bands(spark):
    variants = recency.stack_variants(working(spark), working(spark))
    summary = summaries.scenario_change(
        summaries.scenario_summary(variants, BANK_WINDOWS), BANK_WINDOWS
    )
    rows = summaries.order_scenarios(summary).collect()
    assert [(r["data_variant"], r["threshold_days"], r["customer_count"]) for r in rows] == [
        ("canonical", 30, 3),
        ("canonical", 60, 2),
        ("canonical", 90, 1),
        ("exact_groups_collapsed", 30, 3),
        ("exact_groups_collapsed", 60, 2),
        ("exact_groups_collapsed", 90, 1),
    ]
    assert rows[0]["eligible_population_pct"] == 75.0
    assert rows[0]["transactions_prior_90d_median"] == 3.0
    assert rows[2]["zero_prior_90d_pct"] == 100.0
    assert rows[2]["insufficient_prior_history_customers"] == 1

    bands = summaries.band_summary(working(spark), BANK_WINDOWS).orderBy("band_ordinal").collect()
    assert [row["recency_band"] for row in bands] == [
        "0–30 days",
        "31–60 days",
        "61–90 days",
        "More than 90 days",
    ]
    assert [row["customer_count"] for row in bands] == [1, 1, 1, 1]


def test_empty_groups_are_shown(spark):
    recent_only = working(spark, WORKING_ROWS[:1])
    variants = recency.stack_variants(recent_only, recent_only)
    scenarios = summaries.scenario_summary(variants, BANK_WINDOWS).collect()
    assert len(scenarios) == 6
    assert {row["customer_count"] for row in scenarios} == {0}
    assert {row["transactions_prior_90d_median"] for row in scenarios} == {None}
    bands = summaries.band_summary(recent_only, BANK_WINDOWS).orderBy("band_ordinal").collect()
    assert [row["customer_count"] for row in bands] == [1, 0, 0, 0]


def test_statistics(spark):
    assert one(summaries.recency_statistics(working(spark))) == {
        "customer_count": 4,
        "minimum": 10,
        "q1": 32.5,
        "median": 55.0,
        "q3": 77.5,
        "p90": 91.0,
        "p95": 95.5,
        "maximum": 100,
    }
    trajectory = one(summaries.trajectory_statistics(working(spark), BANK_WINDOWS))
    assert trajectory["customer_count"] == 3
    assert trajectory["excluded_for_limited_history"] == 1
    counts = [trajectory[f"{name}_count"] for name in ("lower", "equal", "higher")]
    assert counts == [2, 0, 1]
    assert trajectory["lower_pct"] == 66.67


def test_sensitivity(spark):
    first = changed(WORKING_ROWS[0], transactions_full_period=19, transactions_recent_90d=4)
    collapsed = working(spark, [first, *WORKING_ROWS[1:]])
    pair = summaries.pair_variants(working(spark), collapsed)
    assert one(summaries.sensitivity_statistics(pair, BANK_WINDOWS)) == {
        "excess_rows_collapsed": 1,
        "affected_customers": 1,
        "maximum_rows_collapsed_for_one_customer": 1,
        "recent_90d_rows_collapsed": 1,
        "prior_90d_rows_collapsed": 0,
        "maximum_absolute_scenario_count_change": 0,
    }


def test_merge_refuses_repeated_keys(spark):
    twice = working(spark, [WORKING_ROWS[0], WORKING_ROWS[0]])
    pair = summaries.pair_variants(working(spark), twice)
    with pytest.raises(Exception, match="merge key is not unique"):
        pair.count()


def test_ecdf_and_population(spark):
    ecdf = summaries.recency_ecdf(working(spark)).orderBy("recency_days").collect()
    assert [row["at_or_below_pct"] for row in ecdf] == [25.0, 50.0, 75.0, 100.0]
    population = summaries.population_summary(working(spark)).collect()
    assert [row["value"] for row in population] == [4, 4, 10, 100, 1]


def test_grain_difference(spark):
    late = changed(WORKING_ROWS[1], recency_days=41)
    other = working(spark, [late, *WORKING_ROWS[2:]])
    assert one(recency.grain_difference(working(spark), other)) == {
        "only_canonical": 1,
        "only_collapsed": 0,
        "recency_differs": 1,
    }


LEDGER = "customer_id long, transaction_date date, amount_cop decimal(20,2), transaction_type string"


def bank_ledger(spark):
    days = [date(2023, 1, 4), date(2023, 8, 1), date(2023, 8, 1), date(2023, 11, 5)]
    rows = [(1, day, 10, "Payment") for day in days]
    rows += [(2, date(2023, 12, 29), 5, "Deposit")]
    rows += [(3, date(2023, 6, 1), 5, "Deposit"), (9, date(2023, 6, 1), 5, "Deposit")]
    return spark.createDataFrame(
        [(c, d, Decimal(a), k) for c, d, a, k in rows], LEDGER
    )


def bank_customers(spark):
    return spark.createDataFrame(
        [(1, True), (2, True), (3, False), (4, True), (5, None)],
        "customer_id long, credit_card boolean",
    )


def test_working_relation_by_hand(spark):
    ledger, customers = bank_ledger(spark), bank_customers(spark)
    arguments = {"windows": BANK_WINDOWS, "eligible": F.col("credit_card")}
    canonical = recency.working_relation(ledger, customers, **arguments)
    rows = {row["customer_id"]: row for row in canonical.collect()}
    assert set(rows) == {1, 2}
    assert tuple(rows[1])[3:] == (360, 54, 4, 1, 2, 3, True)
    assert tuple(rows[2])[3:] == (1, 0, 1, 1, 0, 1, False)
    collapsed = recency.collapsed_working_relation(ledger, customers, **arguments)
    assert tuple(collapsed.filter("customer_id = 1").first())[3:] == (360, 54, 3, 1, 1, 3, True)
    pair = recency.working_relation_pair(ledger, customers, **arguments)
    left, right = recency.split_pair(pair)
    assert left.exceptAll(canonical).count() == canonical.exceptAll(left).count() == 0
    assert right.exceptAll(collapsed).count() == collapsed.exceptAll(right).count() == 0


@pytest.mark.parametrize("words", [4, 1, 0])
def test_active_months_over_many_years(spark, monkeypatch, words):
    """Bits in several numbers, bits that just fit, and the way over months agree."""
    monkeypatch.setattr(recency, "MONTH_WORDS", words)
    months = 64 if words == 1 else 200
    rows = [(c, c * 5 + i * (1 + c % 3)) for c in range(1, 30) for i in range(40)]
    ledger = spark.createDataFrame(rows, "customer_id long, m long").select(
        "customer_id",
        F.expr(f"add_months(date'1990-01-15', cast(m % {months} as int))").alias(
            "transaction_date"
        ),
        F.lit(1).cast("decimal(20,2)").alias("amount_cop"),
        F.lit("Payment").alias("transaction_type"),
    )
    customers = ledger.select("customer_id").distinct()
    arguments = {"windows": BANK_WINDOWS, "eligible": F.lit(True)}
    expected = {c: len({m % months for k, m in rows if k == c}) for c in range(1, 30)}
    canonical = recency.working_relation(ledger, customers, **arguments)
    pair = recency.working_relation_pair(ledger, customers, **arguments)
    for relation in (canonical, *recency.split_pair(pair)):
        found = relation.select("customer_id", "active_months").collect()
        assert {row["customer_id"]: row["active_months"] for row in found} == expected


def busy_ledger(spark):
    """A customer with a third of the rows, copies, and rows without customer, day or type."""
    days = "date_add(date'2023-12-29', -cast(id * 7 % 400 as int))"
    return spark.range(6000).selectExpr(
        "case when id % 3 = 0 then 7 when id % 100 <> 1 then id % 211 end as customer_id",
        f"case when id % 50 <> 2 then {days} end as transaction_date",
        "cast(id % 4 as decimal(20,2)) as amount_cop",
        "case when id % 10 <> 4 then concat('t', id % 3) end as transaction_type",
    )


@pytest.mark.parametrize("few", [0, 1000])
def test_ranges_do_not_change_the_relations(spark, monkeypatch, few):
    ledger = busy_ledger(spark).unionAll(busy_ledger(spark).limit(500))
    customers = spark.sql("select id as customer_id from range(0, 211) union all select id from range(5)")
    arguments = {"windows": BANK_WINDOWS, "eligible": F.col("customer_id") % 4 != 0}

    def found():
        pair = recency.working_relation_pair(ledger, customers, values=True, **arguments)
        frames = [
            recency.working_relation(ledger, customers, **arguments),
            recency.collapsed_working_relation(ledger, customers, **arguments),
            recency.distinct_events(ledger),
            *recency.split_pair(pair),
        ]
        return [Counter(frame.collect()) for frame in frames]

    whole = found()
    monkeypatch.setattr(recency, "TASK_ROWS", 300)
    monkeypatch.setattr(recency, "FEW_CUSTOMERS", few)
    dealt = found()
    assert dealt == whole
    rows = [tuple(row) for row in ledger.collect()]
    eligible = {c for c in range(211) if c % 4}
    full = Counter(row[0] for row in rows if row[0] in eligible)
    groups = Counter(row[0] for row in set(rows) if row[0] in eligible)
    assert full[7] > len(rows) / 3
    for relation, expected in zip([*dealt[:2], *dealt[3:]], (full, groups, full, groups)):
        assert {r["customer_id"]: r["transactions_full_period"] for r in relation} == expected


def test_rows_grouped_by_a_task_are_bounded(spark, monkeypatch):
    """Whatever the shuffle partitions: equal rows meet, and a busy customer is cut into ranges."""
    monkeypatch.setattr(recency, "TASK_ROWS", 300)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        groups = recency.distinct_events(busy_ledger(spark))
        sizes = groups.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(sizes) >= 15
    assert max(row["count"] for row in sizes) <= 3 * 300


@pytest.mark.parametrize("few", [0, 1000])
def test_many_customers_are_joined_once_aggregated(spark, monkeypatch, few):
    """Few are broadcast below the aggregation; no estimate moves the join of many there."""
    monkeypatch.setattr(recency, "FEW_CUSTOMERS", few)
    customers = spark.range(211).withColumnRenamed("id", "customer_id")
    arguments = {"windows": BANK_WINDOWS, "eligible": F.lit(True)}
    for relation in (recency.working_relation, recency.working_relation_pair, recency.collapsed_working_relation):
        found = relation(busy_ledger(spark), customers, **arguments)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.index("Join") < plan.index("Aggregate")) == (few == 0)


def test_empty_ledger(spark):
    working = recency.working_relation(
        bank_ledger(spark).limit(0),
        bank_customers(spark),
        BANK_WINDOWS,
        eligible=F.col("credit_card"),
    )
    assert working.count() == 0


def test_run_analysis(spark, tmp_path):
    ledger, customers = bank_ledger(spark), bank_customers(spark)
    analysis = run_analysis(ledger, customers, expected_population=2)
    assert analysis.canonical.count() == 2
    assert one(analysis.summaries["sensitivity"])["excess_rows_collapsed"] == 1
    write_analysis(analysis, str(tmp_path / "out"))
    table = spark.read.option("header", True).csv(str(tmp_path / "out" / "scenarios"))
    first = table.first()
    assert (first["data_variant"], first["scenario"]) == ("canonical", "More than 30 days")
    assert first["eligible_population_pct"] == "50.00"
    with pytest.raises(AnalysisError, match="population"):
        run_analysis(ledger, customers, expected_population=3)

