"""Sequential row keys in file order, and their integrity."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.numbers import count_where
from tallywright.operators.prefix import running_totals
from tallywright.sources.scratch import stage

SOURCE_FILE = "source_file"
SOURCE_BLOCK = "source_block"
SOURCE_POSITION = "source_position"
SOURCE_TAGS = [SOURCE_FILE, SOURCE_BLOCK, SOURCE_POSITION]

# Splits are file blocks, so there are about as many as the input has blocks of
# spark.sql.files.maxPartitionBytes. Up to this many, their list is broadcast.
BROADCAST_SPLITS = 1_000_000


def tag_position(scanned: DataFrame) -> DataFrame:
    """Add file, block and position to a freshly scanned file source.

    Positions rise within a block in the order of its rows. They are only
    meaningful together, so the tagged rows must be written before the tags are
    used twice (``stage``): a second scan may cut the files differently.
    """
    return scanned.select(
        "*",
        F.col("_metadata.file_path").alias(SOURCE_FILE),
        F.col("_metadata.file_block_start").alias(SOURCE_BLOCK),
        F.monotonically_increasing_id().alias(SOURCE_POSITION),
    )


def number_rows(tagged: DataFrame, name: str) -> DataFrame:
    """Number tagged, staged rows 1, 2, … in file order and drop the tags.

    Only the list of blocks is ordered, in ranges: it holds the first number of each
    block, and a row adds its own distance from the first position in the block.
    """
    splits = tagged.groupBy(SOURCE_FILE, SOURCE_BLOCK).agg(
        F.count("*").alias("n"), F.min(SOURCE_POSITION).alias("first_position")
    )
    numbered, _ = running_totals(splits, [SOURCE_FILE, SOURCE_BLOCK], "n", "until")
    offset = F.col("until") - F.col("n") + 1 - F.col("first_position")
    offsets = stage(numbered.select(SOURCE_FILE, SOURCE_BLOCK, offset.alias("offset")), "offsets")
    if offsets.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    kept = [column for column in tagged.columns if column not in SOURCE_TAGS]
    return tagged.join(offsets, [SOURCE_FILE, SOURCE_BLOCK]).select(
        (F.col(SOURCE_POSITION) + F.col("offset")).alias(name), *kept
    )


def sequential_key(scanned: DataFrame, name: str) -> DataFrame:
    """Number the rows of a freshly scanned file source in file order."""
    return number_rows(stage(tag_position(scanned), "tagged"), name)


def sequential_key_by(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number the rows of any DataFrame in the order of the key columns.

    The other columns break ties, then the place of the row, so that equal keys
    spread over many sort ranges. The sorted rows are written with their range
    and place in it, and numbered from there like rows of files.
    """
    rest = [column for column in df.columns if column not in keys]
    ordered = df.orderBy(*keys, *rest, F.monotonically_increasing_id())
    tagged = ordered.select(
        "*",
        F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias(SOURCE_FILE),
        F.lit(0).cast("bigint").alias(SOURCE_BLOCK),
        F.monotonically_increasing_id().alias(SOURCE_POSITION),
    )
    return number_rows(stage(tagged, "ordered"), name)


def row_key_integrity(
    df: DataFrame,
    key: str,
    more: Mapping[str, tuple[Column, Callable[[str], Column]]] | None = None,
) -> DataFrame:
    """Rows, NULL, repeated, smallest and largest key, one row.

    ``sequential`` is true when the keys are exactly 1 to the number of rows. ``more``
    names measures that the same scan takes: of some rows, and how these are put together.
    """
    more = more or {}
    number = F.col(key).cast("bigint")
    # A bitmap holds 32,768 keys, so what is shuffled is a row per bitmap and task.
    measured = (
        df.groupBy(F.bitmap_bucket_number(number).alias("bucket"))
        .agg(
            F.count("*").alias("row_count"),
            count_where(number.isNull()).alias("null_ids"),
            F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(number))).alias("ids"),
            F.min(key).alias("minimum_id"),
            F.max(key).alias("maximum_id"),
            *[part.alias(name) for name, (part, _) in more.items()],
        )
        .agg(
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum("null_ids"), F.lit(0)).alias("null_ids"),
            F.coalesce(F.sum("ids"), F.lit(0)).alias("distinct_ids"),
            F.min("minimum_id").alias("minimum_id"),
            F.max("maximum_id").alias("maximum_id"),
            *[whole(name).alias(name) for name, (_, whole) in more.items()],
        )
    )
    repeated = F.col("row_count") - F.col("distinct_ids")
    return measured.select(
        "row_count",
        "null_ids",
        repeated.alias("duplicate_id_rows"),
        "minimum_id",
        "maximum_id",
        (
            (F.col("null_ids") == 0)
            & (repeated == 0)
            & F.coalesce(F.col("minimum_id") == 1, F.lit(False))
            & F.coalesce(F.col("maximum_id") == F.col("row_count"), F.lit(False))
        ).alias("sequential"),
        *more,
    )
