"""Raw CSV sources: manifest, header contract and the all-text scan.

A source is a file, or a directory of files written together, with the name the
contract gives it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.contracts import SourceContract
from tallywright.functions.frames import literal_rows
from tallywright.functions.hashing import row_hash
from tallywright.operators.rowkey import tag_position
from tallywright.sources.paths import path_exists
from tallywright.sources.scratch import stage

CORRUPT = "_corrupt_record"
MALFORMED = "malformed"
# A comma outside quotes.
HEADER_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_text_table(
    spark: SparkSession, contract: SourceContract, directory: str, *, multi_line: bool = False
) -> DataFrame:
    """All columns as text, with a column holding lines that are no record.

    Empty fields are NULL. A header that does not match the contract stops the
    scan, in whichever file it is.
    """
    schema = contract.text_schema().add(T.StructField(CORRUPT, T.StringType()))
    return (
        spark.read.schema(schema)
        .options(
            header=True,
            nullValue="",
            escape='"',
            mode="PERMISSIVE",
            columnNameOfCorruptRecord=CORRUPT,
            enforceSchema=False,
            multiLine=multi_line,
        )
        .csv(f"{directory}/{contract.filename}")
    )


def stage_text_table(
    spark: SparkSession, contract: SourceContract, directory: str, *, multi_line: bool = False
) -> DataFrame:
    """The raw table as columns on disk, parsed once, with positions for row keys.

    Profiles, checks and the typed load all start here, so the text is parsed a
    single time and each of them reads only the columns it needs.
    """
    raw = read_text_table(spark, contract, directory, multi_line=multi_line)
    tagged = tag_position(raw)
    return stage(
        tagged.withColumn(MALFORMED, F.col(CORRUPT).isNotNull()).drop(CORRUPT), contract.key
    )


FILE_SCHEMA = (
    "source_key string, file_path string, byte_size bigint, line_count bigint, "
    "invalid_lines bigint, line_xor bigint, line_sum decimal(38,0), header_names array<string>"
)


def file_manifest(
    spark: SparkSession, directory: str, contracts: Sequence[SourceContract]
) -> DataFrame:
    """One row per raw file: source, size, physical lines, their hashes and the header.

    Only what the contracts name is read. ``line_xor`` and ``line_sum`` are the xor and the
    sum of the line hashes; neither depends on how a file is split. A source that doesn't
    exist, or a directory that doesn't, gives no rows.
    """
    files = spark.createDataFrame([], FILE_SCHEMA)
    for contract in contracts:
        path = f"{directory}/{contract.filename}"
        if path_exists(spark, path):
            files = files.unionByName(_files_of(spark, contract.key, path))
    return files


def _files_of(spark: SparkSession, key: str, path: str) -> DataFrame:
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.lit(key).alias("source_key"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("length").alias("byte_size"),
        )
    )
    lines = (
        spark.read.options(lineSep="\n", recursiveFileLookup=True)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.when(
                F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()
            ).alias("first_position"),
            row_hash([T.StructField("value", T.StringType())]).alias("h"),
        )
        .groupBy("file_path")
        .agg(
            F.count("*").alias("line_count"),
            F.count(F.when(~F.is_valid_utf8("value"), 1)).alias("invalid_lines"),
            F.bit_xor("h").alias("line_xor"),
            F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("line_sum"),
            F.min_by("value", "first_position").alias("header"),
        )
    )
    return listed.join(lines, "file_path", "left").select(
        "source_key",
        "file_path",
        "byte_size",
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("invalid_lines", F.lit(0)).alias("invalid_lines"),
        "line_xor",
        "line_sum",
        header_names(F.col("header")).alias("header_names"),
    )


def header_names(line: Column) -> Column:
    """Column names in a CSV header line."""
    names = F.split(F.rtrim(F.regexp_replace(line, "\r$", "")), HEADER_COMMA)
    unquoted = F.transform(names, lambda name: F.regexp_replace(name, '^"(.*)"$', "$1"))
    return F.transform(unquoted, lambda name: F.replace(name, F.lit('""'), F.lit('"')))


def source_manifest(files: DataFrame, contracts: Sequence[SourceContract]) -> DataFrame:
    """One row per expected source; a source without files has ``files = 0``.

    ``data_rows`` counts physical lines without the header of each file. ``fingerprint`` is
    the number, the xor and the sum of the hashes of all lines, so it is the same however
    the lines are dealt to files, and repeated lines count.
    """
    expected = literal_rows(
        files.sparkSession,
        [
            {"source_key": c.key, "source_filename": c.filename, "source_ordinal": ordinal}
            for ordinal, c in enumerate(contracts)
        ],
    )
    found = files.groupBy("source_key").agg(
        F.count("*").alias("files"),
        F.sum("byte_size").alias("byte_size"),
        F.sum("line_count").alias("line_count"),
        F.sum("invalid_lines").alias("invalid_lines"),
        F.sum(F.greatest(F.col("line_count") - 1, F.lit(0))).alias("data_rows"),
        F.format_string(
            "%d:%d:%s",
            F.sum("line_count"),
            F.coalesce(F.bit_xor("line_xor"), F.lit(0).cast("bigint")),
            F.coalesce(F.sum("line_sum"), F.lit(0)).cast("decimal(38,0)").cast("string"),
        ).alias("fingerprint"),
    )
    return expected.join(found, "source_key", "left").select(
        "source_ordinal",
        "source_key",
        "source_filename",
        F.coalesce("files", F.lit(0)).alias("files"),
        "byte_size",
        "line_count",
        "invalid_lines",
        "data_rows",
        "fingerprint",
    )


def header_contract(files: DataFrame, contracts: Sequence[SourceContract]) -> DataFrame:
    """One row per file: missing and unexpected columns, and whether the order matches."""
    expected = literal_rows(
        files.sparkSession,
        [{"source_key": c.key, "expected": ",".join(c.columns)} for c in contracts],
    ).select("source_key", F.split("expected", ",").alias("expected"))
    names = F.coalesce(F.col("header_names"), F.array().cast("array<string>"))
    joined = files.join(F.broadcast(expected), "source_key").withColumn("names", names)
    return joined.select(
        "source_key",
        "file_path",
        F.size("expected").cast("bigint").alias("expected_columns"),
        F.size("names").cast("bigint").alias("observed_columns"),
        F.array_sort(F.array_except("expected", "names")).alias("missing_columns"),
        F.array_sort(F.array_except("names", "expected")).alias("unexpected_columns"),
        (F.col("names") == F.col("expected")).alias("order_matches"),
    )


def header_summary(headers: DataFrame) -> DataFrame:
    """Headers per source; of several files the one that is furthest off."""
    off = F.size("missing_columns") + F.size("unexpected_columns")
    return headers.groupBy("source_key").agg(
        F.max("expected_columns").alias("expected_columns"),
        F.max_by("observed_columns", off).alias("observed_columns"),
        F.max_by("missing_columns", off).alias("missing_columns"),
        F.max_by("unexpected_columns", off).alias("unexpected_columns"),
        F.bool_and("order_matches").alias("order_matches"),
    )


def scanned_counts(
    tables: Sequence[tuple[SourceContract, DataFrame]], manifest: DataFrame
) -> DataFrame:
    """Parsed records and malformed lines per source against the physical lines."""
    counted = None
    for contract, table in tables:
        counts = table.agg(
            F.lit(contract.key).alias("source_key"),
            F.count("*").alias("scanned_rows"),
            F.count(F.when(F.col(MALFORMED), 1)).alias("malformed_rows"),
        )
        counted = counts if counted is None else counted.unionByName(counts)
    return manifest.join(counted, "source_key", "left").select(
        "source_key",
        F.col("data_rows").alias("expected_rows"),
        "scanned_rows",
        "malformed_rows",
        (
            F.col("scanned_rows").eqNullSafe(F.col("data_rows")) & (F.col("malformed_rows") == 0)
        ).alias("matches"),
    )
