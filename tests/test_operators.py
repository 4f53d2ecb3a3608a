"""Casts, repeats, row keys, fingerprints and numbers on small inputs."""

from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.numbers import band_labels, percentage, recency_band
from tallywright.functions.text import lenient_cast, null_label, strict_cast
from tallywright.operators.fingerprint import fingerprint
from tallywright.operators.summaries import merge_one_to_one
from tallywright.operators.relationships import (
    childless,
    count_distribution,
    orphans,
    rows_per_customer,
)
from tallywright.operators.repeats import flag_integrity, flag_repeats, repeat_profile
from tallywright.operators.rowkey import row_key_integrity, sequential_key, sequential_key_by
from tallywright.sources.scratch import scratch_root, stage


def column(spark, values, kind="string"):
    return spark.createDataFrame([(value,) for value in values], f"v {kind}")


@pytest.mark.parametrize(
    ("kind", "values", "expected"),
    [
        (T.IntegerType(), ["1", " 2 ", "1.5", "1e2", "x", "", None], [1, 2] + [None] * 5),
        (T.LongType(), ["01", "9999999999", "99999999999999999999"], [1, 9999999999, None]),
        (
            T.DateType(),
            ["2023-01-04", "2023", "2023-01", "2023-13-01", "2023-1-4", "04/01/2023"],
            [date(2023, 1, 4)] + [None] * 5,
        ),
        (T.DoubleType(), ["1", "-.5", "1e3", "1d", "abc"], [1.0, -0.5, 1000.0, None, None]),
        (T.BooleanType(), ["True", "false", "yes", "maybe"], [True, False, True, None]),
        (
            T.DecimalType(20, 2),
            ["10", "12.345", "1,5"],
            [Decimal("10.00"), Decimal("12.35"), None],
        ),
        (T.StringType(), ["  a ", " ", ""], ["a", None, None]),
    ],
)
def test_lenient_cast(spark, kind, values, expected):
    df = column(spark, values).select(lenient_cast("v", kind).alias("v"))
    assert [row["v"] for row in df.collect()] == expected


def test_strict_cast(spark):
    good = column(spark, ["2023-01-04", " ", None])
    cast = strict_cast("v", T.DateType(), "t.day").alias("v")
    assert [row["v"] for row in good.select(cast).collect()] == [date(2023, 1, 4), None, None]
    with pytest.raises(Exception, match="t.day holds a value that is not date: 2023"):
        column(spark, ["2023"]).select(cast).collect()


def test_null_label(spark):
    labels = column(spark, [" a", "", None]).select(null_label("v").alias("v")).collect()
    assert [row["v"] for row in labels] == ["a", "<NULL>", "<NULL>"]


@pytest.mark.parametrize(
    ("n", "d", "expected"),
    [(0, 0, 0.0), (1, 3, 33.33), (2, 3, 66.67), (1, 800, 0.12), (3, 800, 0.38), (5, 5, 100.0)],
)
def test_percentage_rounds_ties_to_even(spark, n, d, expected):
    df = spark.range(1).select(F.lit(n).alias("n"), F.lit(d).alias("d"))
    assert df.select(percentage(F.col("n"), F.col("d")).alias("p")).first()["p"] == expected
    assert expected == (round(n / d * 100, 2) if d else 0.0)


def test_bands(spark):
    df = column(spark, [-1, 0, 30, 31, 60, 61, 90, 91], "long")
    found = df.select(recency_band(F.col("v"), (30, 60, 90)).alias("b")).collect()
    assert [row["b"] for row in found] == [None, 0, 0, 1, 1, 2, 2, 3]
    assert band_labels((2, 5)) == ["0–2 days", "3–5 days", "More than 5 days"]


KEYS = ["k", "d"]


def brute_flags(rows):
    counts = Counter(rows)
    return Counter((row, counts[row] > 1) for row in rows)


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    rows=st.lists(
        st.tuples(st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3])),
        min_size=1,
        max_size=40,
    ),
    limit=st.sampled_from([0, 1, 2, 1000]),
)
def test_flag_repeats_against_brute_force(spark, rows, limit):
    df = spark.createDataFrame(rows, "k string, d int").repartition(3)
    flagged = flag_repeats(df, KEYS, "flag", broadcast_groups=max(limit, 1))
    found = Counter(((row["k"], row["d"]), row["flag"]) for row in flagged.collect())
    assert found == brute_flags(rows)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_one_group_holds_a_third(spark, limit):
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), F.lit(0).cast("long").alias("d"))
    rest = spark.range(40_000).select(
        F.concat(F.lit("c"), (F.col("id") % 15_000).cast("string")).alias("k"),
        (F.col("id") % 7).alias("d"),
    )
    df = hot.unionByName(rest)
    flagged = flag_repeats(df, KEYS, "flag", broadcast_groups=limit)
    assert flagged.count() == 60_000
    assert flagged.filter("k = 'hot' AND NOT flag").count() == 0
    expected = df.groupBy(*KEYS).count().filter("count > 1").agg(F.sum("count")).first()[0]
    profile = flag_integrity(flagged, KEYS, "flag").first()
    assert profile["flagged_rows"] == profile["rows_in_duplicate_groups"] == expected
    assert repeat_profile(df, KEYS).first()["rows_in_duplicate_groups"] == expected


def test_rows_found_by_broadcast_are_spread(spark):
    """In the long-list path no partition of the shuffle holds the hot group."""
    hot = spark.range(30_000).select(F.lit("hot").alias("k"), F.lit(0).cast("long").alias("d"))
    pairs = spark.range(100).select(F.col("id").cast("string").alias("k"), F.col("id").alias("d"))
    df = hot.unionByName(pairs).unionByName(pairs).repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flagged = flag_repeats(df, KEYS, "flag", broadcast_groups=5)
        sizes = flagged.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(row["count"] for row in sizes) < 10_000


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_sequential_key_by_does_not_depend_on_partitions(spark, partitions):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(partitions)
    keyed = sequential_key_by(df, ["v"], "n")
    assert keyed.filter("n <> v + 1").count() == 0
    assert row_key_integrity(keyed, "n").first()["sequential"]


def test_sequential_key_by_with_equal_rows(spark):
    keyed = sequential_key_by(spark.range(500).select(F.lit(1).alias("v")), ["v"], "n")
    assert row_key_integrity(keyed, "n").first()["sequential"]


def test_sequential_key_follows_files_and_blocks(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(5000).repartitionByRange(3, "id").sortWithinPartitions("id").write.csv(path)
    settings = {
        "spark.sql.files.maxPartitionBytes": "4000",
        "spark.sql.files.openCostInBytes": "100",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        scanned = spark.read.schema("id long").csv(path)
        assert scanned.rdd.getNumPartitions() > 3
        keyed = sequential_key(scanned, "n").cache()
        assert keyed.count() == 5000
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert keyed.filter("n <> id + 1").count() == 0


@pytest.mark.parametrize(
    ("ids", "expected"),
    [
        ([1, 2, 3], True),
        ([1, 2, 4], False),
        ([2, 3, 4], False),
        ([1, 2, 2], False),
        ([1, 2, None], False),
    ],
)
def test_row_key_integrity(spark, ids, expected):
    assert row_key_integrity(column(spark, ids, "long"), "v").first()["sequential"] is expected


def test_fingerprint_depends_on_rows_only(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("s"))
    prints = {tuple(fingerprint(df.repartition(n)).first()) for n in (1, 4, 16)}
    assert len(prints) == 1
    assert tuple(fingerprint(df.filter("id <> 5")).first()) not in prints


@pytest.mark.parametrize(
    ("left", "right"),
    [
        (("a", None), (None, "a")),
        (("a|b", "c"), ("a", "b|c")),
        (("\\N", "x"), (None, "x")),
        (("a\\", "b"), ("a", "\\b")),
        (("", "a"), (None, "a")),
    ],
)
def test_fingerprint_tells_rows_apart(spark, left, right):
    prints = [
        tuple(fingerprint(spark.createDataFrame([row], "a string, b string")).first())
        for row in (left, right)
    ]
    assert prints[0] != prints[1]


def test_relationships(spark):
    customers = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id long")
    ledger = spark.createDataFrame([(1,), (1,), (9,), (9,), (None,)], "id long")
    counts = rows_per_customer(ledger, F.col("id"))
    assert tuple(orphans(counts, customers, F.col("id")).first()) == (3, 1)
    assert childless(customers, F.col("id"), counts).first()[0] == 4
    assert tuple(count_distribution(counts).first()) == (3, 1, 1.6667, 2.0, 2.0, 2)


def test_stage_writes_to_the_scratch_folder(spark):
    other = spark.newSession()
    staged = stage(other.range(5), "numbers")
    assert staged.count() == 5
    path = staged.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert str(scratch_root(other)) in path
    assert staged.columns == ["id"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        class conf:
            @staticmethod
            def get(name, default):
                return default

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Cluster)


def test_row_keys_by_bitmaps(spark):
    def measured(keys):
        rows = spark.createDataFrame([(key,) for key in keys], "k long")
        found = row_key_integrity(rows.repartition(3), "k").first().asDict()
        return found["row_count"], found["null_ids"], found["duplicate_id_rows"], found["sequential"]

    many = list(range(1, 70_001))
    assert measured(many) == (70_000, 0, 0, True)
    assert measured([*many[:-1], 1]) == (70_000, 0, 1, False)
    assert measured([1, 2, 4]) == (3, 0, 0, False)
    assert measured([None, 1, 2]) == (3, 1, 1, False)
    assert measured([-1, 0, 1, -1, -40_000, 32_768, 32_769]) == (7, 0, 1, False)
    assert measured([]) == (0, 0, 0, False)


def test_merge_fails_on_repeated_keys_whatever_the_plan(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, x string")
    right = spark.createDataFrame([(1, "d")], "k long, y string")
    rules = "spark.sql.optimizer.excludedRules"
    for excluded in ("", "org.apache.spark.sql.catalyst.optimizer.PushDownPredicates"):
        spark.conf.set(rules, excluded)
        try:
            for sides in ((left, right), (right, left)):
                with pytest.raises(Exception, match="merge key is not unique"):
                    merge_one_to_one(*sides, "k").collect()
            assert merge_one_to_one(left.limit(2), right, "k").collect() == [(1, "a", "d")]
        finally:
            spark.conf.unset(rules)
