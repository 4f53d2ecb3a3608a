"""Exact duplicates: counting quotient filters route repeated fingerprints to a comparison of bytes.

The fingerprint of a text is cut into a quotient and a remainder. Each partition builds
a counting quotient filter of its fingerprints: one bit per quotient tells whether it
occurs, one bit per remainder whether it ends its quotient's run, and counters stand
beside remainders met more than once. Filters are cut by their leading bits into
segments; the segments of one range are merged by their sorted remainders without loss,
as a filter holds every bit of its fingerprints. Only texts whose fingerprint counts above
one in the merged filter are compared, byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.tasks import arrow_map, batch, signed
from tallywright.sources.scratch import stage

BITS = 64
#: Fingerprints of a merged segment, about; the memory of a task grows with it alone.
SEGMENT = 1 << 20
#: A list of groups up to this long is broadcast; of a longer one, only the large groups.
FEW = 100_000

FILTER = (
    "segment int, segment_bits int, quotient_bits int, occupied binary, ends binary, "
    "remainders binary, counted binary, counts binary"
)


def _bits_for(count: int) -> int:
    return max(count - 1, 0).bit_length()


def to_filter(prints: np.ndarray, counts: np.ndarray, bits: int, segment_bits: int, segment: int) -> dict:
    """The counting quotient filter of sorted distinct fingerprints that share a segment."""
    quotient_bits = min(bits, segment_bits + _bits_for(len(prints)))
    rest = bits - quotient_bits
    quotients = prints >> np.uint64(rest) if rest < 64 else np.zeros_like(prints)
    local = (quotients & np.uint64((1 << (quotient_bits - segment_bits)) - 1)).astype(np.int64)
    occupied = np.zeros(1 << (quotient_bits - segment_bits), bool)
    occupied[local] = True
    ends = np.append(local[1:] != local[:-1], True)
    remainders = prints & np.uint64((1 << rest) - 1)
    width = -(-rest // 8)
    counted = np.flatnonzero(counts > 1)
    return {
        "segment": segment,
        "segment_bits": segment_bits,
        "quotient_bits": quotient_bits,
        "occupied": np.packbits(occupied).tobytes(),
        "ends": np.packbits(ends).tobytes(),
        "remainders": remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(),
        "counted": counted.astype("<u4").tobytes(),
        "counts": counts[counted].astype("<i8").tobytes(),
    }


def from_filter(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    rest = bits - row["quotient_bits"]
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(row["occupied"], np.uint8)))
    ends = np.unpackbits(np.frombuffer(row["ends"], np.uint8))
    width = -(-rest // 8)
    size = int(np.flatnonzero(ends)[-1]) + 1
    run = np.concatenate([[0], np.cumsum(ends[: size - 1], dtype=np.int64)])
    head = np.uint64(row["segment"] << (row["quotient_bits"] - row["segment_bits"]))
    prints = (head | occupied[run].astype(np.uint64)) << np.uint64(rest) if rest < 64 else np.zeros(size, np.uint64)
    if width:
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = np.frombuffer(row["remainders"], np.uint8).reshape(size, width)
        prints |= wide.view("<u8").ravel()
    counts = np.ones(size, np.int64)
    counts[np.frombuffer(row["counted"], "<u4")] = np.frombuffer(row["counts"], "<i8")
    return prints, counts


def merged(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of fingerprints as one, counts of equal ones added up."""
    if len(filters) == 1:
        return filters[0]
    prints = np.concatenate([own for own, _ in filters])
    counts = np.concatenate([own for _, own in filters])
    order = np.argsort(prints, kind="stable")  # merges the runs that are sorted already
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def _rows(filters: list[dict]) -> pa.RecordBatch:
    names = [field.split()[0] for field in FILTER.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5
    columns = [pa.array([row[name] for row in filters], kind) for name, kind in zip(names, kinds)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _segments(prints: np.ndarray, counts: np.ndarray, bits: int, segment_bits: int) -> pa.RecordBatch:
    if segment_bits:
        segment = (prints >> np.uint64(bits - segment_bits)).astype(np.int64)
    else:
        segment = np.zeros(len(prints), np.int64)
    edges = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(prints)]
    return _rows(
        [
            to_filter(prints[low:high], counts[low:high], bits, segment_bits, int(segment[low]))
            for low, high in zip(edges, edges[1:])
            if low < high
        ]
    )


def _build(bits: int, segment_bits: int, most: int):
    """The filter of a partition's fingerprints, cut into segments."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for part in parts:
            found = part.column("fingerprint").to_numpy().view(np.uint64)
            pending.append(np.unique(found, return_counts=True))
            size += len(pending[-1][0])
            if size >= most:
                pending = [merged(pending)]
                size = len(pending[0][0])
                if size >= most:
                    yield _segments(*pending[0], bits, segment_bits)
                    pending, size = [], 0
        if size:
            yield _segments(*merged(pending), bits, segment_bits)

    return run


def _merge(bits: int, most: int):
    """One filter of all filters of a segment, which stand one after another."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pending, size = None, [], 0
        for part in parts:
            for row in part.to_pylist():
                key = row["segment"], row["segment_bits"]
                if key != current and pending:
                    yield _rows([to_filter(*merged(pending), bits, current[1], current[0])])
                    pending, size = [], 0
                current = key
                pending.append(from_filter(row, bits))
                size += len(pending[-1][0])
                if size >= 2 * most:
                    pending = [merged(pending)]
                    size = 0
        if pending:
            yield _rows([to_filter(*merged(pending), bits, current[1], current[0])])

    return run


def fingerprint_filter(prints: DataFrame, bits: int = BITS, segment: int = SEGMENT) -> DataFrame:
    """The counting quotient filter of a ``fingerprint`` column, a row per segment.

    There are enough segments that one holds about ``segment`` fingerprints, and no
    fewer than Spark has shuffle partitions. What is shuffled is a row per segment and
    partition with its distinct fingerprints, so copies count once.
    """
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(parts, -(-prints.count() // segment))
    segment_bits = min(bits, 20, _bits_for(wanted))
    built = arrow_map(prints.select("fingerprint"), _build(bits, segment_bits, segment), FILTER)
    placed = built.repartition("segment").sortWithinPartitions("segment")
    return arrow_map(placed, _merge(bits, segment), FILTER)


def repeated_prints(filters: DataFrame, bits: int = BITS) -> DataFrame:
    """``fingerprint, met`` of the fingerprints that a filter counts more than once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                prints, counts = from_filter(row, bits)
                often = counts > 1
                yield batch(fingerprint=signed(prints[often]), met=counts[often])

    return arrow_map(filters, run, "fingerprint long, met long")


def _least_large(groups: DataFrame, rows: str, few: int) -> int:
    """Groups of more rows than this number ``few`` at most; 0 if all groups do."""
    size = groups.agg(F.count("*"), F.sum(rows)).first()
    return 0 if size[0] <= few else size[1] // few


def _routed(rows: DataFrame, repeated: DataFrame, least: int) -> DataFrame:
    """The rows whose fingerprint is repeated.

    Large groups are found by a broadcast of bounded size. Where there are others, their
    rows are shuffled without those of large groups.
    """
    large = F.broadcast(repeated.where(F.col("met") > least).select("fingerprint"))
    found = rows.join(large, "fingerprint", "left_semi")
    if not least:
        return found
    small = repeated.where(F.col("met") <= least).select("fingerprint")
    rest = rows.join(large, "fingerprint", "left_anti").join(small, "fingerprint", "left_semi")
    return found.unionByName(rest)


def _attached(rows: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Rows with what their class of copies holds, null where they have no copy."""
    keys = ["fingerprint", "sha"]
    large = F.broadcast(classes.where(F.col("group_size") > least))
    found = rows.join(large, keys, "left")
    if not least:
        return found
    small = classes.where(F.col("group_size") <= least)
    rest = rows.join(large, keys, "left_anti").join(small, keys, "left")
    return found.where("group_size is not null").unionByName(rest)


def exact_copies(
    documents: DataFrame,
    normalise: Callable[[Column], Column] | None = None,
    bits: int = BITS,
    segment: int = SEGMENT,
    few: int = FEW,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``documents``.

    Texts are equal if their bytes are, after ``normalise`` where one is given. Of
    equal texts the row with the largest ``doc_id`` stays; ``keep_id`` names it,
    ``group_size`` counts the rows and ``kept`` tells whether this row is the one.

    A null text is an empty one, and empty texts are equal. A null ``doc_id`` is smaller
    than any other; of rows that share text and ``doc_id`` exactly one stays. Other
    columns are ignored, an empty table gives no rows. Texts of any length are taken
    whole; a group may hold any share of the rows.

    Fingerprints of fewer ``bits`` only route more texts to the comparison.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    text = normalise(text) if normalise else text
    fingerprint = F.xxhash64("text")
    if bits < BITS:
        fingerprint = F.shiftrightunsigned(fingerprint, BITS - bits)
    whole = documents.select("doc_id", text.alias("text")).withColumn("fingerprint", fingerprint)
    rows = stage(
        whole.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row_no"),
            "fingerprint",
            F.unhex(F.sha2("text", 256)).alias("sha"),
        ),
        "fingerprints",
    )
    filters = stage(fingerprint_filter(rows, bits, segment), "quotient_filter")
    repeated = stage(repeated_prints(filters, bits), "repeated_fingerprints")
    least = _least_large(repeated, "met", few)
    # Copies are combined where they are read, so a text is shuffled once per task.
    equal = (
        _routed(whole, repeated, least)
        .groupBy("fingerprint", "text")
        .agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        .where("group_size > 1")
        .select("fingerprint", F.unhex(F.sha2("text", 256)).alias("sha"), "group_size", "keep_id")
    )
    last = (
        _routed(rows, repeated, least)
        .groupBy("fingerprint", "sha")
        .agg(F.max(F.struct("doc_id", "row_no"))["row_no"].alias("last_row"))
    )
    classes = stage(equal.join(last, ["fingerprint", "sha"]), "copies")
    found = _attached(rows, classes, _least_large(classes, "group_size", few))
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_no") == F.col("last_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
