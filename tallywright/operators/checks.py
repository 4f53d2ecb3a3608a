"""Checks: code, status, message and metrics.

Spark reduces the data to a row of measures; whether a check holds is then a
matter of comparing a few numbers, which the driver does. Check rows become a
DataFrame again to be stored, counted and reported.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

PASS, WARNING, FAIL = "pass", "warning", "fail"
STATUSES = (PASS, WARNING, FAIL)

CHECK_SCHEMA = T.StructType(
    [
        T.StructField("check_ordinal", T.IntegerType()),
        T.StructField("check_code", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("metrics", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Check:
    """Outcome of one check."""

    code: str
    status: str
    message: str
    metrics: Mapping[str, object] = field(default_factory=dict)

    @property
    def failed(self) -> bool:
        return self.status == FAIL


def check(
    code: str, holds: object, good: str, bad: str, *, breach: str = FAIL, **metrics: object
) -> Check:
    """A check that passes or is breached; an unknown (NULL) condition is a breach."""
    if holds:
        return Check(code, PASS, good, metrics)
    return Check(code, breach, bad, metrics)


def has_failures(checks: Iterable[Check]) -> bool:
    """Whether any blocking check failed."""
    return any(found.failed for found in checks)


def measure(*parts: DataFrame) -> dict[str, object]:
    """The measures of several one-row DataFrames, by name.

    The jobs do not depend on each other, so they are submitted together and
    one fills the executors that another leaves idle.
    """
    first = inheritable_thread_target(parts[0].sparkSession)(lambda part: part.first())
    with ThreadPoolExecutor(len(parts)) as pool:
        rows = pool.map(first, parts)
        measured: dict[str, object] = {}
        for row in rows:
            measured.update(row.asDict(recursive=True))
    return measured


def pick(measured: Mapping[str, object], *names: str) -> dict[str, object]:
    """Some measures under their own names."""
    return {name: measured[name] for name in names}


def metrics_json(metrics: Mapping[str, object]) -> str:
    """Metrics as JSON: sorted keys, decimals as text, dates as ISO text."""
    return json.dumps(
        metrics, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=_json_value
    )


def check_frame(spark: SparkSession, checks: Iterable[Check]) -> DataFrame:
    """Checks as a DataFrame with ordinals from 1."""
    rows = [
        (ordinal, found.code, found.status, found.message, metrics_json(found.metrics))
        for ordinal, found in enumerate(checks, start=1)
    ]
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def status_counts(checks: DataFrame) -> DataFrame:
    """Checks per status, all three statuses present."""
    counts = [
        F.struct(
            F.lit(status).alias("status"),
            F.count(F.when(F.col("status") == status, 1)).alias("checks"),
        )
        for status in STATUSES
    ]
    return checks.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def _json_value(value: object) -> object:
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Row):
        return value.asDict(recursive=True)
    raise TypeError(f"{type(value).__name__} has no JSON form")
