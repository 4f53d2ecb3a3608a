"""The corpus pipeline: five operators in turn, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm.jaccard import keep_one_of_each_group
from tallywright.llm.mixing import repeat_by_rate
from tallywright.llm.packing import pack
from tallywright.llm.queries import labelled_domains, table
from tallywright.llm.secret_scan import redact_secrets
from tallywright.llm.weak_labels import keep_quality
from tallywright.sources.scratch import in_turn


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    return keep_quality(docs)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_each_group(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains below their target weight are repeated; every document stays."""
    return repeat_by_rate(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", duplicates_stage),
    ("secret_scans", secrets_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained classifiers, decoding and tokenizing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again.

    A stage's tables are deleted once the next stage's documents are written.
    """

    def step(function):
        return lambda docs: function(spark, docs, sf_dir)

    return in_turn(table(spark, sf_dir, "documents"), [(name, step(function)) for name, function in STAGES])
