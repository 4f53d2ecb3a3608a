"""Paths in whatever file system Spark reads them from."""

from __future__ import annotations

from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name."""
    place, files = _place(spark, path)
    return files.exists(place)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; of many who try, whoever is told True created it."""
    place, files = _place(spark, path)
    files.mkdirs(place.getParent())
    if files.getUri().getScheme() == "file":
        # Hadoop looks first and creates then; the system does both at once.
        return spark._jvm.java.io.File(place.toUri().getPath()).createNewFile()
    try:
        files.create(place, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all in it, if it is there."""
    place, files = _place(spark, path)
    files.delete(place, True)


def folders(spark: SparkSession, path: str) -> dict[str, datetime]:
    """Folders within a folder, and when each was changed last."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return {}
    return {
        found.getPath().getName(): datetime.fromtimestamp(found.getModificationTime() / 1000, UTC)
        for found in files.listStatus(place)
        if found.isDirectory()
    }


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())
