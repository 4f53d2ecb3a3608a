"""Runs last: it removes what the other tests have staged."""

import os

from tallywright.sources.scratch import drop_staged, scratch_root, stage


def test_drop_staged(spark):
    staged = stage(spark.range(5), "numbers")
    folder = f"{scratch_root(spark)}/tallywright/{spark.sparkContext.applicationId}"
    assert staged.count() == 5 and os.path.isdir(folder)
    drop_staged(spark)
    assert not os.path.exists(folder)
