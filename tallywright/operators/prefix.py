"""Running totals over any number of rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.sources.scratch import stage

_PART = "__part"


def running_totals(df: DataFrame, keys: Sequence[str], value: str, name: str) -> tuple[DataFrame, int]:
    """Add to each row the total of ``value`` up to and with it, in the order of the keys.

    Also gives the total of all rows. The keys must tell rows apart. A window over all rows would bring them to
    one task. Rows are dealt to ranges of keys instead, each range is summed up on its
    own, and the sums of the ranges before it, of which there are as many as shuffle
    partitions, are added.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(
        df.repartitionByRange(parts, *keys).withColumn(_PART, F.spark_partition_id()), "ranges"
    )
    sums = sorted((part, total or 0) for part, total in dealt.groupBy(_PART).agg(F.sum(value)).collect())
    until = list(accumulate(total for _, total in sums))
    before = spark.createDataFrame(
        [(part, end - total) for (part, total), end in zip(sums, until, strict=True)],
        f"{_PART} int, __before long",
    )
    inside = W.partitionBy(_PART).orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__before")
    totals = dealt.join(F.broadcast(before), _PART).select(*df.columns, running.alias(name))
    return totals, until[-1] if until else 0
