"""Published versions of a pair of tables.

A version is a folder that is written once. What is published is the version
with the highest number in a small log, so publishing is a single file appearing, and
an earlier version stays as it was. No clock decides, and no two builders get one number.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallywright.sources.paths import claim, folders, path_exists, remove

#: Whatever is published so far.
ANY = "*"
#: Seconds that a builder has for its record once it has a number, and between looks.
PATIENCE, PAUSE = 30.0, 0.2
LOG_SCHEMA = "publish_number bigint, build_id string, published_at_utc timestamp"


class PublishConflict(RuntimeError):
    """Another build was published first."""


@dataclass(frozen=True)
class Version:
    """Paths of the tables of one version."""

    target: str
    build_id: str

    @property
    def path(self) -> str:
        return f"{self.target}/versions/{self.build_id}"

    @property
    def customers(self) -> str:
        return f"{self.path}/source/customers"

    @property
    def ledger(self) -> str:
        return f"{self.path}/source/transactions"

    @property
    def build_info(self) -> str:
        return f"{self.path}/meta/build_info"

    @property
    def validation_results(self) -> str:
        return f"{self.path}/meta/validation_results"

    @property
    def tables(self) -> list[str]:
        return [self.customers, self.ledger, self.build_info, self.validation_results]


def latest_row(df: DataFrame, condition: Column, by: str) -> DataFrame:
    """The matching row with the largest value, or none."""
    return df.filter(condition).orderBy(F.desc(by)).limit(1)


def published_version(spark: SparkSession, target: str) -> Version | None:
    """The version the log names last, or None if nothing was ever published.

    A log that can't be read, or that names no version, is an error.
    """
    row = _last_publish(spark, target)
    if row is None:
        return None
    if row["build_id"] is None or row["publish_number"] is None:
        raise ValueError(f"the log of {target} names no version")
    return Version(target, row["build_id"])


def _last_publish(spark: SparkSession, target: str) -> Row | None:
    rows = _log(spark, target)
    return None if rows is None else latest_row(rows, F.lit(True), "publish_number").first()


def _log(spark: SparkSession, target: str) -> DataFrame | None:
    log = f"{target}/publishes"
    if not path_exists(spark, log):
        return None
    return spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", True).parquet(log)


def publish(
    spark: SparkSession, version: Version, *, replaces: str | None = ANY, patience: float = PATIENCE
) -> None:
    """Make a complete version the published one, under the next number.

    With ``replaces``, the id of the build that is published so far or None, it fails if
    another one has come in between. Of builders that publish at once one gets
    the number, by creating a file that only one can create; the others look again. A
    builder that has the number and writes no record within ``patience`` seconds is taken
    for dead, and its number is passed over.
    """
    passed = 0
    while True:
        last = _last_publish(spark, version.target)
        if replaces is not ANY and (last["build_id"] if last else None) != replaces:
            raise PublishConflict(f"another build has been published at {version.target}")
        number = max(last["publish_number"] if last else 0, passed) + 1
        if claim(spark, f"{version.target}/claims/{number:010d}"):
            break
        if not _appears(spark, f"{version.target}/publishes/{number:010d}/_SUCCESS", patience):
            passed = number
    spark.range(1).select(
        F.lit(number).cast("bigint").alias("publish_number"),
        F.lit(version.build_id).alias("build_id"),
        F.current_timestamp().alias("published_at_utc"),
    ).coalesce(1).write.mode("errorifexists").parquet(f"{version.target}/publishes/{number:010d}")


def _appears(spark: SparkSession, path: str, patience: float) -> bool:
    end = time.monotonic() + patience
    while not path_exists(spark, path):
        if time.monotonic() >= end:
            return False
        time.sleep(PAUSE)
    return True


def remove_versions(
    spark: SparkSession, target: str, *, keep: int = 1, unchanged_for: timedelta = timedelta(days=1)
) -> list[str]:
    """Remove all versions but the last ``keep`` that were published, and name them.

    Versions changed more recently than that stay, as they may be in the making.
    """
    if keep < 1:
        raise ValueError("the published version has to stay")
    published = _log(spark, target)
    last = [] if published is None else published.orderBy(F.desc("publish_number")).limit(keep).collect()
    kept = {row["build_id"] for row in last}
    latest = datetime.now(UTC) - unchanged_for
    gone = [
        name
        for name, changed in folders(spark, f"{target}/versions").items()
        if name not in kept and changed <= latest
    ]
    for name in gone:
        remove(spark, Version(target, name).path)
    return sorted(gone)


def read_published(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """Customers and ledger of the published version; an error if there is none."""
    version = published_version(spark, target)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {target}")
    return spark.read.parquet(version.customers), spark.read.parquet(version.ledger)


def byte_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; 0 if it does not exist."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException:
        return 0
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()["bytes"]
