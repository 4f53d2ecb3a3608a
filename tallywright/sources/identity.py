"""Content identity of raw files in the order of their lines: a tree of digests.

Lines are numbered from the start of the first file of a source, and the hashes of so
many lines in turn make a block, whatever split they were read in. The digest of a block
is a line of the level above, until one is left. Two files of the same lines in
another order, or with lines moved from one place to another, differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.contracts import SourceContract
from tallywright.functions.hashing import row_hash
from tallywright.operators.rowkey import number_rows, tag_position
from tallywright.sources.paths import path_exists
from tallywright.sources.scratch import stage

#: Lines of a block, and digests of a block of the levels above.
BLOCK = 4096
IDENTITY = "source_key string, byte_size bigint, line_count bigint, ordered_digest string"


def source_identity(
    spark: SparkSession, directory: str, contracts: Sequence[SourceContract], block: int = BLOCK
) -> DataFrame:
    """``source_key, byte_size, line_count, ordered_digest`` per source that exists.

    All lines count, headers included; files come in the order of their paths. The bytes
    are those of the lines and one line end each, whether or not the last line has one.
    """
    found = spark.createDataFrame([], IDENTITY)
    for contract in contracts:
        path = f"{directory}/{contract.filename}"
        if path_exists(spark, path):
            found = found.unionByName(_identity(spark, contract.key, path, block))
    return found


def _identity(spark: SparkSession, key: str, path: str, block: int) -> DataFrame:
    lines = spark.read.options(lineSep="\n", recursiveFileLookup=True).text(path)
    tagged = tag_position(lines).select(
        *[F.col(name) for name in ("source_file", "source_block", "source_position")],
        row_hash([T.StructField("value", T.StringType())]).cast("string").alias("mark"),
        (F.octet_length("value") + 1).cast("bigint").alias("bytes"),
    )
    numbered = stage(number_rows(stage(tagged, "line_marks"), "line"), "lines")
    measured = numbered.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("byte_size"), F.count("*").alias("line_count")
    )
    row = measured.first()
    digest = ordered_digest(numbered, F.col("line") - 1, row["line_count"], block)
    return spark.createDataFrame([(key, row["byte_size"], row["line_count"], digest)], IDENTITY)


def ordered_digest(marks: DataFrame, place: Column, count: int, block: int = BLOCK) -> str:
    """The root of the tree over ``mark`` in the order of its place, 0 to ``count`` - 1.

    A task holds the marks of the blocks it combines, each of bounded size.
    """
    level = marks.select(place.cast("bigint").alias("place"), "mark")
    while True:
        level = level.groupBy(F.floor(F.col("place") / block).cast("bigint").alias("place")).agg(
            F.array_sort(F.collect_list(F.struct("place", "mark"))).alias("marks")
        )
        level = level.select(
            "place", F.md5(F.array_join(F.transform("marks", lambda one: one["mark"]), ",")).alias("mark")
        )
        count = -(-count // block)
        if count <= 1:
            row = level.first()
            return row["mark"] if row else ""
