"""Helpers shared by the operators: Arrow tasks, words, hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Odd 64-bit multipliers for combining hashes.
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, also where it isn't on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="tallywright-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(f"{folder}/tallywright", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def arrow_map(df: DataFrame, task: Rows, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with the package at hand on every worker, and columns of the schema's types."""
    ship(df.sparkSession)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types, names = to_arrow_schema(schema), df.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in task(part.rename_columns(names) for part in parts):
            # ids may come as another kind of whole number than they go
            same = part.schema.types == types.types
            yield part if same else pa.RecordBatch.from_arrays(
                [own.cast(kind) for own, kind in zip(part.columns, types.types)], names=part.schema.names
            )
        give_back()

    # Spark looks columns up by name here, and stumbles over dots and backticks.
    return df.toDF(*[f"c{at}" for at in range(len(names))]).mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and many wait side by side."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def named(name: str) -> Column:
    """The column of that very name, be there dots or backticks in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def batch(**columns) -> pa.RecordBatch:
    """A record batch from numpy arrays, Arrow arrays or lists."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def texts_of(part: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [value or b"" for value in part.column(name).cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z as a-z."""
    return text.lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` consecutive hashes."""
    count = len(hashes) - size + 1
    folded = hashes[:count].copy()
    for shift in range(1, size):
        folded = folded * _FOLD + hashes[shift : shift + count]
    return mixed(folded)


def shingles_of(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles.

    A text of fewer words is one shingle of all its words; a text without words
    has none.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
        return np.array([whole], np.uint64)
    return np.unique(window_hashes(hashes_of(words), size))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
