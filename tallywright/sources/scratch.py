"""Tables written on the way, in the folder the cluster shares for that."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
#: Paths that ``stage`` has written within ``_noted``, if that is under way.
_noting: ContextVar[list[str] | None] = ContextVar("noting", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    In local mode, where every task runs on this machine, a temporary folder
    stands in when the setting is missing. On a cluster there is no such
    substitute: executors could not read what others wrote.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        root = tempfile.mkdtemp(prefix="tallywright-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _local_roots[context.applicationId] = root
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder of this application that nothing else uses."""
    return f"{_application_folder(spark)}/{uuid4().hex}/{name}"


def drop_staged(spark: SparkSession) -> None:
    """Delete all this application has staged, once nothing reads it any more."""
    _delete(spark, _application_folder(spark))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to scratch and read it back.

    What follows starts from files instead of recomputing, also after executors
    are lost, and the optimizer knows the true size.
    """
    path = scratch_path(df.sparkSession, name)
    noted = _noting.get()
    if noted is not None:
        noted.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_turn(
    first: DataFrame, steps: Iterable[tuple[str, Callable[[DataFrame], DataFrame]]]
) -> DataFrame:
    """Apply named steps one after another, each to the table that the one before wrote.

    What a step stages on its way is deleted as soon as its own table is written, and that
    table once the next one is, so scratch never holds more than one step's tables and its
    input. ``first`` isn't touched. Tables that a step stages may be read by that step
    alone. A step that fails leaves nothing behind.
    """
    spark, table, before = first.sparkSession, first, []
    for name, step in steps:
        with _noted() as paths:
            try:
                following = stage(step(table), name)
            except BaseException:
                _delete(spark, *before, *paths)
                raise
        own = paths.pop()
        _delete(spark, *before, *paths)
        table, before = following, [own]
    return table


@contextmanager
def _noted() -> Iterator[list[str]]:
    """The paths that ``stage`` writes meanwhile, in their order; those around it get them, too."""
    outer, paths = _noting.get(), []
    token = _noting.set(paths)
    try:
        yield paths
    finally:
        _noting.reset(token)
        if outer is not None:
            outer.extend(paths)


def _delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tallywright/{spark.sparkContext.applicationId}"
