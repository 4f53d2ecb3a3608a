"""Exact order statistics and quantiles of any number of distinct values.

Sorting all values, or holding all of them in one buffer, would bring a whole column
to one task. Instead borders from approximate quantiles cut the values into
buckets, the exact weight of each bucket tells in which ones the wanted ranks
lie, and only those are cut again. Once few rows are left they are listed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.sources.scratch import stage

#: Rows that are listed instead of being cut again.
LISTED_ROWS = 50_000
#: Buckets a range is cut into per round, by shares of its rows and by its width.
SHARES, STEPS = 48, 4


@dataclass
class _Range:
    """Values in which some ranks lie, and the weight of all values below them."""

    before: int
    ranks: list[int]


def values_at_ranks(
    df: DataFrame,
    value: str,
    ranks: Sequence[int],
    weight: str | None = None,
    *,
    listed_rows: int = LISTED_ROWS,
) -> dict[int, Any]:
    """The values at the given ranks, 1 being the smallest; NULL has no rank.

    ``weight`` is a column of whole numbers telling how often a row counts. Values are
    numbers, dates or timestamps. Every round reads only what the one before left, and
    its buckets hold a small share of that, so the number of rounds grows with the
    logarithm of the rows. A value that many rows share is a bucket of its own.
    """
    if not ranks:
        return {}
    rows = df.select(
        F.col(value).alias("value"),
        (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("weight"),
        F.lit(0).alias("place"),
    ).where(F.col("value").isNotNull() & (F.col("weight") > 0))
    ranges, found = {0: _Range(0, sorted(set(ranks)))}, {}
    while ranges:
        spans = _spans(rows)
        if sum(span["rows"] for span in spans.values()) <= listed_rows:
            found.update(_listed(rows, ranges))
            break
        borders = {place: _borders(span) for place, span in spans.items()}
        rows, ranges, met = _cut(rows, ranges, borders)
        found.update(met)
    missing = sorted(set(ranks) - set(found))
    if missing:
        raise ValueError(f"there are no rows of rank {missing}")
    return found


def exact_percentiles(
    df: DataFrame,
    value: str,
    shares: Sequence[float],
    weight: str | None = None,
    *,
    listed_rows: int = LISTED_ROWS,
) -> list[float | None]:
    """Quantiles between 0 and 1, on a line between the two values next to each.

    Gives what ``percentile`` gives, without holding all distinct values in one task. All
    are None if there is no value.
    """
    counted = F.count(value) if weight is None else F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    total = df.agg(F.coalesce(counted, F.lit(0))).first()[0]
    if not total:
        return [None] * len(shares)
    places = [share * (total - 1) for share in shares]
    ranks = {math.floor(place) + 1 for place in places} | {math.ceil(place) + 1 for place in places}
    at = values_at_ranks(df, value, sorted(ranks), weight, listed_rows=listed_rows)

    def between(place: float) -> float:
        low, high = math.floor(place), math.ceil(place)
        if low == high:
            return float(at[low + 1])
        return (high - place) * float(at[low + 1]) + (place - low) * float(at[high + 1])

    return [between(place) for place in places]


def quantile_table(
    df: DataFrame, value: str, shares: Sequence[float], *, listed_rows: int = LISTED_ROWS
) -> DataFrame:
    """``share, quantile`` for each share, NULL where there is no value."""
    found = exact_percentiles(df, value, shares, listed_rows=listed_rows)
    return df.sparkSession.createDataFrame(
        list(zip(map(float, shares), found, strict=True)), "share double, quantile double"
    )


def cut_points(
    df: DataFrame, value: str, bins: int, *, highest_first: bool = False, listed_rows: int = LISTED_ROWS
) -> list[Any]:
    """Values that cut the rows into ``bins`` groups of equal size, ties kept together.

    A row belongs to the group numbered by how many points it lies beyond: above them,
    or below them if the highest come first. That is the number of rows before it, in
    units of a group's size, rounded down.
    """
    total = df.agg(F.count(value)).first()[0]
    if not total:
        return []
    ranks = [-(-step * total // bins) for step in range(1, bins)]
    if highest_first:
        ranks = [total + 1 - rank for rank in ranks]
    at = values_at_ranks(df, value, ranks, listed_rows=listed_rows)
    return [at[rank] for rank in ranks]


def group_number(value: Column, points: Sequence[Any], *, highest_first: bool = False) -> Column:
    """The group of a value among cut points, from 1; NULL has none."""
    number = F.lit(1)
    for point in points:
        beyond = value < F.lit(point) if highest_first else value > F.lit(point)
        number = number + F.when(beyond, 1).otherwise(0)
    return F.when(value.isNotNull(), number)


def _spans(rows: DataFrame) -> dict[int, Any]:
    """Per range its rows, ends and approximate quantiles."""
    shares = F.array(*[F.lit(step / SHARES) for step in range(1, SHARES)])
    found = rows.groupBy("place").agg(
        F.count("*").alias("rows"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.percentile_approx("value", shares, 1000).alias("shares"),
    )
    return {row["place"]: row for row in found.collect()}


def _borders(span: Any) -> list[Any]:
    """Border values of a range, without repeats.

    Approximate quantiles of decimals are as exact as doubles, so numbers that agree
    in their first digits need borders by width as well.
    """
    low, high = span["low"], span["high"]
    borders = {low, high, *(x for x in span["shares"] if low <= x <= high)}
    if isinstance(low, float) and not math.isfinite(high - low):
        return sorted(borders, key=lambda x: (x != x, x))
    if isinstance(low, Decimal):
        digits = -min(low.as_tuple().exponent, high.as_tuple().exponent)
        with localcontext(prec=100):
            first, last = (int(end.scaleb(digits)) for end in (low, high))
            borders.update(Decimal(x).scaleb(-digits) for x in _steps(first, last))
    elif isinstance(low, int):
        borders.update(_steps(low, high))
    else:
        borders.update(low + (high - low) * step / STEPS for step in range(1, STEPS))
    return sorted(borders)


def _steps(low: int, high: int) -> list[int]:
    return [low + (high - low) * step // STEPS for step in range(1, STEPS)]


def _bucket(borders: Sequence[Any], first: int, low: int, high: int) -> Column:
    """Numbers of the open ranges between borders and, in between, of the borders themselves."""
    if low == high:
        return F.lit(first + 2 * low)
    middle = (low + high) // 2
    value, border = F.col("value"), F.lit(borders[middle])
    return (
        F.when(value < border, _bucket(borders, first, low, middle))
        .when(value == border, first + 2 * middle + 1)
        .otherwise(_bucket(borders, first, middle + 1, high))
    )


def _cut(
    rows: DataFrame, ranges: dict[int, _Range], borders: dict[int, list[Any]]
) -> tuple[DataFrame, dict[int, _Range], dict[int, Any]]:
    """What is left of the rows, the smaller ranges, and the values met as borders."""
    firsts, number = {}, 0
    for place, own in borders.items():
        firsts[place] = number
        number += 2 * len(own) + 1
    bucket = F.lit(None).cast("int")
    for place, own in borders.items():
        bucket = F.when(F.col("place") == place, _bucket(own, firsts[place], 0, len(own))).otherwise(bucket)
    cut = rows.select("value", "weight", bucket.alias("place"))
    weights = dict(cut.groupBy("place").agg(F.sum("weight")).collect())
    smaller, met = {}, {}
    for place, span in ranges.items():
        before, wanted = span.before, list(span.ranks)
        for at in range(2 * len(borders.get(place, [])) + 1):
            bucket_number = firsts.get(place, 0) + at
            until = before + weights.get(bucket_number, 0)
            inside = [rank for rank in wanted if before < rank <= until]
            if inside and at % 2:
                met.update(dict.fromkeys(inside, borders[place][at // 2]))
            elif inside:
                smaller[bucket_number] = _Range(before, inside)
            before = until
    if smaller:
        rows = stage(cut.where(F.col("place").isin(list(smaller))), "ranks")
    return rows, smaller, met


def _listed(rows: DataFrame, ranges: dict[int, _Range]) -> dict[int, Any]:
    """The values at the ranks, from a list of the values left."""
    found, lists = {}, {}
    for place, value, weight in rows.groupBy("place", "value").agg(F.sum("weight")).collect():
        lists.setdefault(place, []).append((value, weight))
    for place, span in ranges.items():
        before, wanted = span.before, list(span.ranks)
        for value, weight in sorted(lists.get(place, []), key=lambda row: (row[0] != row[0], row[0])):
            before += weight
            while wanted and wanted[0] <= before:
                found[wanted.pop(0)] = value
    return found
