"""Steps written in turn, and what they leave in the shared folder."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallywright.sources.scratch import in_turn, scratch_root, stage


def tables(spark):
    folder = f"{scratch_root(spark)}/tallywright/{spark.sparkContext.applicationId}"
    found = (f"{root}/{name}" for root, names, _ in os.walk(folder) for name in names)
    return {path for path in found if os.path.exists(f"{path}/_SUCCESS")}


def doubled(df):
    staged = stage(df.withColumn("id", F.col("id") * 2), "inner")
    return staged.union(stage(staged.limit(0), "nothing"))


def named(paths):
    return sorted(path.rsplit("/", 1)[1] for path in paths)


def test_only_the_last_table_is_left(spark):
    before = tables(spark)
    seen = []

    def watched(df):
        seen.append(named(tables(spark) - before))
        return doubled(df)

    first = stage(spark.range(5), "first")
    result = in_turn(first, [("one", watched), ("two", watched), ("three", watched)])
    assert sorted(row.id for row in result.collect()) == [0, 8, 16, 24, 32]
    assert seen == [["first"], ["first", "one"], ["first", "two"]]
    assert named(tables(spark) - before) == ["first", "three"]
    assert first.count() == 5


def test_steps_within_a_step(spark):
    before = tables(spark)

    def nested(df):
        return in_turn(df, [("a", doubled), ("b", doubled)])

    result = in_turn(spark.range(3), [("one", nested), ("two", nested)])
    assert sorted(row.id for row in result.collect()) == [0, 16, 32]
    assert named(tables(spark) - before) == ["two"]


def test_a_failed_step_leaves_nothing(spark):
    before = tables(spark)

    def fails(df):
        stage(df, "inner")
        return df.select(F.raise_error(F.lit("broken")).alias("id"))

    with pytest.raises(Exception, match="broken"):
        in_turn(spark.range(3), [("one", doubled), ("two", fails)])
    assert tables(spark) == before


def test_no_steps(spark):
    assert in_turn(spark.range(3), []).count() == 3
