"""Order statistics, quantiles and running totals against sorting everything."""

import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tallywright.operators.prefix import running_totals
from tallywright.operators.ranks import (
    cut_points,
    exact_percentiles,
    group_number,
    quantile_table,
    values_at_ranks,
)


def samples(kind, rng, count=3000):
    if kind == "long":
        return "long", [rng.choice([rng.randrange(-(2**62), 2**62), 7, 8]) for _ in range(count)]
    if kind == "ties":
        return "int", [rng.choice([1, 1, 1, 1, 2, 90]) for _ in range(count)]
    if kind == "decimal":
        return "decimal(20,2)", [Decimal(rng.randrange(-(10**6), 10**6)) / 100 for _ in range(count)]
    if kind == "like decimals":  # alike as doubles
        return "decimal(38,2)", [Decimal(10) ** 33 + Decimal(rng.randrange(10**6)) / 100 for _ in range(count)]
    if kind == "double":
        odd = [math.inf, -math.inf, 0.0, 1e-300, 1e300]
        return "double", [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) ** 9, *odd]) for _ in range(count)]
    if kind == "date":
        return "date", [date(2000, 1, 1) + timedelta(days=rng.randrange(5000)) for _ in range(count)]
    start = datetime(2000, 1, 1)
    return "timestamp", [start + timedelta(microseconds=rng.randrange(10**15)) for _ in range(count)]


KINDS = ["long", "ties", "decimal", "like decimals", "double", "date", "timestamp"]


@pytest.mark.parametrize("kind", KINDS)
def test_ranks_equal_sorting(spark, kind):
    rng = random.Random(kind)
    name, values = samples(kind, rng)
    frame = spark.createDataFrame([(value,) for value in [*values, None, None]], f"v {name}").repartition(5)
    ranks = [1, 2, 1500, 3000, *rng.sample(range(1, 3000), 2)]
    found = values_at_ranks(frame, "v", ranks, listed_rows=300)
    ordered = sorted(values)
    assert found == {rank: ordered[rank - 1] for rank in ranks}


def test_weights_count_rows_often(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(10_000), rng.choice([0, 1, 2, 1000])) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "v long, w long")
    ordered = sorted(value for value, weight in rows for _ in range(weight))
    ranks = [1, len(ordered) // 3, len(ordered) // 2, len(ordered)]
    found = values_at_ranks(frame, "v", ranks, "w", listed_rows=30)
    assert found == {rank: ordered[rank - 1] for rank in ranks}


def test_ranks_that_are_not_there(spark):
    frame = spark.createDataFrame([(1,), (None,)], "v long")
    assert values_at_ranks(frame, "v", []) == {}
    with pytest.raises(ValueError, match="rank"):
        values_at_ranks(frame, "v", [1, 2])


@pytest.mark.parametrize("listed", [50_000, 50])
def test_percentiles_are_those_of_the_function(spark, listed):
    rng = random.Random(8)
    rows = [(Decimal(rng.randrange(10**5)) / 100, rng.randrange(4)) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "v decimal(20,2), w long")
    shares = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0]
    wanted = F.array(*[F.lit(share) for share in shares])
    plain = frame.agg(F.percentile("v", wanted)).first()[0]
    assert exact_percentiles(frame, "v", shares, listed_rows=listed) == pytest.approx(plain, abs=1e-9)
    weighted = frame.agg(F.percentile("v", wanted, F.col("w"))).first()[0]
    assert exact_percentiles(frame, "v", shares, "w", listed_rows=listed) == pytest.approx(weighted, abs=1e-9)


def test_percentiles_of_nothing(spark):
    frame = spark.createDataFrame([(None,)], "v long")
    assert exact_percentiles(frame, "v", [0.5, 1.0]) == [None, None]
    assert [tuple(row) for row in quantile_table(frame, "v", [0.5]).collect()] == [(0.5, None)]


@pytest.mark.parametrize("bins", [1, 2, 5, 10])
def test_groups_hold_the_rows_before(spark, bins):
    rng = random.Random(bins)
    values = [rng.choice([1, 2, 3, rng.randrange(100)]) for _ in range(500)]
    frame = spark.createDataFrame([(value,) for value in values], "v long")
    for best_low in (False, True):
        points = cut_points(frame, "v", bins, highest_first=best_low)
        rows = frame.select("v", group_number(F.col("v"), points, highest_first=best_low).alias("g")).collect()
        for value, group in rows:
            before = sum(own > value if best_low else own < value for own in values)
            assert group == 1 + bins * before // len(values)


@pytest.mark.parametrize("count", [0, 1, 5, 2000])
def test_running_totals_equal_adding_up(spark, count):
    rng = random.Random(count)
    rows = [(at // 7, at % 7, rng.randrange(-5, 100)) for at in range(count)]
    shuffled = rng.sample(rows, count)
    frame = spark.createDataFrame(shuffled, "a long, b long, n long").repartition(6)
    totals, whole = running_totals(frame, ["a", "b"], "n", "until")
    assert whole == sum(row[2] for row in rows)
    assert sorted(map(tuple, totals.collect())) == [
        (*row, until) for row, until in zip(rows, accumulate(row[2] for row in rows))
    ]
