"""Several windows, values, mix and segments, against results worked out one row at a time."""

import math
import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywright.contracts import LedgerColumns, RecencyWindows
from tallywright.operators import engagement, recency, summaries

LEDGER = "customer_id long, transaction_date date, amount_cop decimal(20,2), transaction_type string"
TODAY = date(2024, 1, 30)
WINDOWS = RecencyWindows(TODAY, 10)


def everybody():
    return {"customer_key": "customer_id", "eligible": F.lit(True)}


def random_ledger(seed, rows=3000, customers=40):
    rng = random.Random(seed)
    ledger = []
    for _ in range(rows):
        # customer 1 holds a third of the rows
        customer = 1 if rng.random() < 0.33 else rng.randrange(customers)
        day = TODAY - timedelta(days=rng.randrange(0, 60))
        amount = rng.choice([None, Decimal("-5.25"), Decimal("0.10"), Decimal("10.00"), Decimal("999999.99")])
        ledger.append((customer, day, amount, rng.choice(["A", "B", "C", None])))
    return ledger


def customers_of(spark, ledger):
    return spark.createDataFrame([(key,) for key in sorted({row[0] for row in ledger})] * 2, "customer_id long")


@pytest.fixture(scope="module")
def ledger():
    return random_ledger(1)


def test_windows_equal_counting_each(spark, ledger):
    frame = spark.createDataFrame(ledger, LEDGER)
    found = engagement.recency_windows(
        frame, customers_of(spark, ledger), TODAY, (3, 7, 14, 30), **everybody()
    ).collect()
    assert len(found) == len({row[0] for row in ledger})
    for row in found:
        ages = [(TODAY - own[1]).days for own in ledger if own[0] == row.customer_id]
        assert row.transactions_full_period == len(ages)
        for days in (3, 7, 14, 30):
            assert row[f"transactions_recent_{days}d"] == sum(age < days for age in ages)
            assert row[f"transactions_prior_{days}d"] == sum(days <= age < 2 * days for age in ages)
            assert row[f"sufficient_history_{days}d"] == (max(ages) >= 2 * days - 1)


def test_windows_agree_with_the_working_relation(spark, ledger):
    frame, customers = spark.createDataFrame(ledger, LEDGER), customers_of(spark, ledger)
    names = [WINDOWS.recent_column, WINDOWS.prior_column, "transactions_full_period"]
    one = recency.working_relation(frame, customers, WINDOWS, **everybody()).select("customer_id", *names)
    many = engagement.recency_windows(frame, customers, TODAY, (10, 5), **everybody()).select("customer_id", *names)
    assert Counter(one.collect()) == Counter(many.collect())


def test_windows_scan_the_ledger_once(spark, ledger, tmp_path):
    spark.createDataFrame(ledger, LEDGER).write.parquet(str(tmp_path / "ledger"))
    frame = spark.read.parquet(str(tmp_path / "ledger"))
    for windows in ((30,), tuple(range(5, 90, 5))):
        found = engagement.recency_windows(frame, customers_of(spark, ledger), TODAY, windows, **everybody())
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 1


def test_values_of_both_variants(spark, ledger):
    frame = spark.createDataFrame(ledger, LEDGER).repartition(7)
    found = engagement.value_measures(frame, customers_of(spark, ledger), WINDOWS, **everybody()).collect()
    for row in found:
        own = [x for x in ledger if x[0] == row.customer_id]
        if row.data_variant == recency.COLLAPSED:
            own = list(set(own))

        def total(rows):
            return sum((x[2] for x in rows if x[2] is not None), Decimal("0.00"))

        recent = [x for x in own if (TODAY - x[1]).days < 10]
        prior = [x for x in own if 10 <= (TODAY - x[1]).days < 20]
        assert row.transactions_full_period == len(own)
        assert row.amount_full_period == total(own)
        assert row.amount_recent_10d == total(recent)
        assert row.amount_prior_10d == total(prior)
        assert row.amount_change == total(recent) - total(prior)
        assert row.mean_amount_full_period == float(total(own)) / len(own)
        assert row.mean_amount_recent_10d == (float(total(recent)) / len(recent) if recent else None)


def test_values_need_the_amount_among_the_repeat_keys(spark, ledger):
    keys = LedgerColumns(repeat_keys=("customer_id", "transaction_date"))
    frame = spark.createDataFrame(ledger, LEDGER)
    with pytest.raises(ValueError, match="amount"):
        engagement.value_measures(frame, customers_of(spark, ledger), WINDOWS, columns=keys, **everybody())


def test_a_sum_of_too_many_digits_is_null(spark):
    large = Decimal("9" * 36 + ".99")
    rows = [(1, TODAY, large, "A"), (1, TODAY, large, "B"), (1, TODAY, large, "B"), (2, TODAY, large, "A")]
    frame = spark.createDataFrame(rows, LEDGER.replace("20,2", "38,2"))
    found = engagement.value_measures(frame, customers_of(spark, rows), WINDOWS, **everybody())
    amounts = {(x.data_variant, x.customer_id): x.amount_full_period for x in found.collect()}
    assert amounts[recency.CANONICAL, 2] == amounts[recency.COLLAPSED, 2] == large
    assert amounts[recency.CANONICAL, 1] is None and amounts[recency.COLLAPSED, 1] is None


def test_counts_are_the_same_with_values(spark, ledger):
    frame, customers = spark.createDataFrame(ledger, LEDGER), customers_of(spark, ledger)
    plain = recency.stack_pair(recency.working_relation_pair(frame, customers, WINDOWS, **everybody()))
    more = recency.stack_pair(recency.working_relation_pair(frame, customers, WINDOWS, values=True, **everybody()))
    shuffles = [x._jdf.queryExecution().executedPlan().toString().count("Exchange hash") for x in (plain, more)]
    assert shuffles[0] == shuffles[1]
    assert Counter(plain.collect()) == Counter(more.select(plain.columns).collect())


@pytest.mark.parametrize("kinds", [("A", "B"), ("A", "B", "C", "Z"), ()])
def test_mix_equals_counting_each(spark, ledger, kinds):
    frame = spark.createDataFrame(ledger, LEDGER)
    found = engagement.transaction_mix(frame, customers_of(spark, ledger), kinds, **everybody()).collect()
    for row in found:
        own = Counter(x[3] for x in ledger if x[0] == row.customer_id)
        total = own.total()
        assert (row.transactions, row.types) == (total, len(own))
        for kind in kinds:
            assert row[f"transactions_{kind.lower()}"] == own[kind]
            assert abs(row[f"{kind.lower()}_pct"] - 100 * own[kind] / total) <= 0.005001
        assert row.transactions_other == sum(n for kind, n in own.items() if kind not in kinds)
        named = {kind: n for kind, n in own.items() if kind is not None} or own
        top = min(named, key=lambda kind: (-named[kind], kind or ""))
        assert (row.top_type, row.top_type_transactions) == (top, own[top])
        entropy = -sum(n / total * math.log2(n / total) for n in own.values())
        assert row.entropy_bits == pytest.approx(entropy, abs=1e-6)


def test_top_type_of_a_tie_and_of_null_alone(spark):
    rows = [(1, TODAY, None, "B"), (1, TODAY, None, "A"), (2, TODAY, None, None), (3, TODAY, None, None)]
    rows += [(3, TODAY, None, None), (3, TODAY, None, "Z")]
    found = engagement.transaction_mix(
        spark.createDataFrame(rows, LEDGER), customers_of(spark, rows), ("A",), **everybody()
    )
    assert {x.customer_id: (x.top_type, x.entropy_bits) for x in found.collect()} == {
        1: ("A", 1.0),
        2: (None, 0.0),
        3: ("Z", 0.918296),
    }


def scores(values, best_low):
    known = [value for value in values if value is not None]

    def score(value):
        if value is None:
            return None
        before = sum(own > value if best_low else own < value for own in known)
        return 1 + 5 * before // len(known)

    return [score(value) for value in values]


def measures_of(seed, rows=700):
    rng = random.Random(seed)
    return [
        (
            at,
            rng.choice([None, *range(12)]),
            rng.choice([1, 1, 1, 2, 3, rng.randrange(1000)]),
            None if rng.random() < 0.05 else Decimal(rng.randrange(10**6)) / 100,
        )
        for at in range(rows)
    ]


MEASURES = "customer_id long, recency_days long, transactions_full_period long, amount_full_period decimal(38,2)"


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("listed", [50_000, 20])
def test_segments_keep_ties_and_do_not_depend_on_partitions(spark, parts, listed):
    rows = measures_of(4)
    frame = spark.createDataFrame(rows, MEASURES).repartition(parts)
    found = {x.customer_id: x for x in engagement.engagement_segments(frame, listed_rows=listed).collect()}
    wanted = zip(
        rows,
        scores([row[1] for row in rows], True),
        scores([row[2] for row in rows], False),
        scores([row[3] for row in rows], False),
    )
    for (key, *_), r, f, v in wanted:
        row = found[key]
        assert (row.recency_score, row.frequency_score, row.value_score) == (r, f, v)
        if None in (r, f, v):
            name = engagement.UNSCORED
        else:
            name = next(
                s.name
                for s in engagement.SEGMENTS
                if all(low <= x <= high for x, (low, high) in ((r, s.recency), (f, s.frequency), (v, s.value)))
            )
        assert row.segment == name


def test_segments_of_few_customers(spark):
    assert engagement.engagement_segments(spark.createDataFrame([], MEASURES)).collect() == []
    row = engagement.engagement_segments(spark.createDataFrame([(1, 3, 4, Decimal(5))], MEASURES)).first()
    assert (row.recency_score, row.frequency_score, row.value_score) == (1, 1, 1)


def test_no_window_over_all_customers(spark):
    found = engagement.engagement_segments(spark.createDataFrame(measures_of(5, 50), MEASURES))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_segment_summary_and_profile(spark):
    rows = measures_of(6)
    segmented = engagement.engagement_segments(spark.createDataFrame(rows, MEASURES))
    summary = engagement.segment_summary(segmented).collect()
    own = defaultdict(list)
    for x in segmented.collect():
        own[x.segment].append(x)
    assert {x.segment: x.customers for x in summary} == {name: len(x) for name, x in own.items()}
    for x in summary:
        assert x.amount == sum(y.amount_full_period or 0 for y in own[x.segment])
        assert x.transactions == sum(y.transactions_full_period for y in own[x.segment])
    people = spark.createDataFrame([(at, "xyz"[at % 3]) for at in range(600)] * 2, "key long, letter string")
    profile = engagement.segment_profile(segmented, people, {"letter": F.col("letter")}, customer_key="key")
    expected = Counter(
        (name, "xyz"[x.customer_id % 3] if x.customer_id < 600 else None) for name, xs in own.items() for x in xs
    )
    assert {(x.segment, x.value): x.customers for x in profile.collect()} == expected


def test_hexagons_are_those_of_the_nearest_centre(spark):
    rng = random.Random(2)
    points = [(rng.randrange(40), rng.randrange(40), True) for _ in range(500)]
    names = f"{WINDOWS.prior_column} long, {WINDOWS.recent_column} long, sufficient_prior_history boolean"
    found = summaries.activity_hexagons(spark.createDataFrame(points, names), WINDOWS, cells=9).collect()
    cap = found[0].axis_cap
    width = cap / 9
    centres = {
        (q, r): ((q + r / 2) * width, r * math.sqrt(0.75) * width) for q in range(-15, 30) for r in range(-2, 20)
    }
    inside = [(p, r) for p, r, _ in points if p <= cap and r <= cap]
    assert sum(x.customers for x in found) == len(inside)
    counts = {(x.column, x.row): x.customers for x in found}
    slack = Counter()
    for p, r in inside:
        apart = {cell: math.dist((p, r), centre) for cell, centre in centres.items()}
        nearest = [cell for cell, own in apart.items() if own <= min(apart.values()) + 1e-9]
        assert any(cell in counts for cell in nearest)
        if len(nearest) == 1:
            slack[nearest[0]] += 1
    assert all(counts[cell] >= n for cell, n in slack.items())
    for x in found:
        assert (x.prior_centre, x.recent_centre) == pytest.approx(centres[x.column, x.row], abs=1e-6)


def test_relative_change_is_null_where_there_was_nothing(spark):
    names = "data_variant string, scenario string, threshold_days int, customer_count long, "
    names += f"{WINDOWS.prior_column}_median double, customer_count_change_vs_canonical long, "
    names += "prior_median_change_vs_canonical double"
    rows = [("a", "s", 30, 90, 4.5, -10, -0.5), ("a", "t", 60, 0, None, 0, None), ("a", "u", 90, 5, 1.0, 5, 1.0)]
    found = summaries.scenario_relative_change(spark.createDataFrame(rows, names), WINDOWS).collect()
    assert [tuple(x)[3:] for x in found] == [(-10.0, -10.0), (None, None), (None, None)]


def test_the_whole_of_it(spark, ledger):
    from tallywright.plans.analysis import run_engagement

    found = run_engagement(
        spark.createDataFrame(ledger, LEDGER),
        customers_of(spark, ledger),
        WINDOWS,
        kinds=("A", "B"),
        characteristics={"even": F.col("customer_id") % 2 == 0},
        **everybody(),
    )
    people = len({row[0] for row in ledger})
    for name in ("segments", "mix", "windows"):
        assert found[name].count() == people
    assert sum(row.customers for row in found["summary"].collect()) == people
    assert sum(row.customers for row in found["profile"].collect()) == people
    assert "transactions_recent_30d" in found["windows"].columns
