"""Clustering, exact copies and fill-in-middle against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle.compare import connect, differences
from tallywright.llm import clusters, exact_copies, queries
from tallywright.llm.clusters import Simplex, bounds, cluster_vectors, nearest
from tallywright.llm.exact_copies import from_filter, merged, to_filter
from tallywright.llm.infill import fill_in_middle, restored

SF = "/root/testdata/sf0.001"
TABLES = "doc_id long, text string, n long, sha string, fingerprint long, form string, vector string"


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_exact_copies", "op13_fill_in_middle"])
def test_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) is None


# --- clustering


def clustered(rows, clusters_wanted=8, rounds=10, size=64):
    """k-means in Python's own integers."""
    kept = [
        (key, [math.floor(1024 * x) if abs(x) < 2**52 else int(x) * 1024 for x in vector])
        for key, vector in rows
        if vector is not None
        and len(vector) == size
        and all(x is not None and math.isfinite(x) for x in vector)
    ]
    def draw(row):
        key = "~" if row[0] is None else hashlib.sha256(f"3:{row[0]}".encode()).hexdigest()
        return key, b"".join((x & 0xFFFFFFFF).to_bytes(4, "little") for x in row[1])

    centroids = [vector for _, vector in sorted(kept, key=draw)[:clusters_wanted]]

    def assign():
        apart = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        return [(min(range(len(own)), key=own.__getitem__), min(own)) for own in apart]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, vector), (cluster, _) in zip(kept, assign()):
            members[cluster].append(vector)
        for cluster, own in members.items():
            centroids[cluster] = [sum(column) // len(own) for column in zip(*own)]
    final = assign()
    inertia = Counter()
    for cluster, apart in final:
        inertia[cluster] += apart

    def long(value):
        return value if value < 2**63 else None

    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter(
        (key, cluster, long(apart), long(inertia[cluster]), long(inertia.total()), digest[cluster])
        for (key, _), (cluster, apart) in zip(kept, final)
    )


def vectors_of(count, size, rng, scale=1.0):
    centres = rng.normal(size=(5, size))
    return [(scale * (centres[at % 5] + rng.normal(size=size) / 3)).tolist() for at in range(count)]


@pytest.mark.parametrize("scale", [0.3, 1e5, 1e30])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    rows = list(enumerate(vectors_of(150, 64, rng, scale)))
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, rows[2][1]), (3, rows[7][1]), (500, [0.0] * 64)]
    odd = [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 65), (604, [float("nan")] + [1.0] * 63)]
    odd += [(605, [float("-inf")] * 64), (606, [None] + [1.0] * 63)]
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows + odd], "vec_id long, embedding array<double>, cluster int, vector string")
    found = cluster_vectors(frame.repartition(5))
    assert Counter(tuple(row) for row in found.collect()) == clustered(rows)


def test_one_wide_vector_among_others(spark):
    rows = list(enumerate(vectors_of(60, 64, np.random.default_rng(6), 0.5)))
    rows += [(100, [1e9] + [0.25] * 63), (101, [1.7e308] * 64), (102, [-1.7e308] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(row) for row in cluster_vectors(frame).collect()) == clustered(rows)


@pytest.mark.parametrize("count", [0, 1, 3])
def test_fewer_vectors_than_clusters(spark, count):
    rows = list(enumerate(vectors_of(count, 64, np.random.default_rng(7))))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    floats = [(key, np.float32(vector).tolist()) for key, vector in rows]
    assert Counter(tuple(row) for row in cluster_vectors(frame).collect()) == clustered(floats)


def test_clusters_do_not_depend_on_the_base(spark, monkeypatch):
    frame = queries.table(spark, SF, "embeddings")
    expected = Counter(tuple(row) for row in cluster_vectors(frame).collect())
    for share in (0.0, 10.0):
        monkeypatch.setattr(clusters, "HIGH", share)
        assert Counter(tuple(row) for row in cluster_vectors(frame.repartition(3)).collect()) == expected


@pytest.mark.parametrize("size", [1, 3, 10, 64])
def test_bounds_hold(size):
    rng = np.random.default_rng(size)
    points = np.floor(rng.normal(size=(300, 64)) * 500)
    for pivots in (points[:size], np.repeat(points[:3], 4, axis=0), np.zeros((2, 64))):
        simplex = Simplex(pivots)
        low, high = bounds(simplex.project(points), simplex.project(points[:40]))
        apart = ((points[:, None] - points[None, :40]) ** 2).sum(axis=2)
        assert (low <= apart).all() and (apart <= high).all()


def test_far_centroids_are_ruled_out():
    rng = np.random.default_rng(8)
    centres = np.floor(rng.normal(size=(8, 64)) * 900)
    vectors = (centres[rng.integers(0, 8, 2000)] + np.floor(rng.normal(size=(2000, 64)) * 60)).astype(np.int64)
    simplex = Simplex(centres + 20)
    chosen = centres.astype(int).tolist()
    found, compared = nearest(vectors, chosen, simplex.project(vectors.astype(float)), simplex)
    plain, all_of_them = nearest(vectors, chosen, None, simplex)
    assert (found == plain).all()
    assert compared < all_of_them / 10


def test_ties_go_to_the_smaller_number():
    vectors = np.array([[0, 0], [3, 3], [5, 5]])
    found, _ = nearest(vectors, [[1, 1], [-1, -1], [5, 5], [5, 5]], None, Simplex(np.zeros((0, 2))))
    assert found.tolist() == [0, 0, 2]


# --- exact copies


def copies_of(rows):
    """Expected rows; of rows alike in text and id it doesn't matter which one stays."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    found = Counter()
    for text, keys in groups.items():
        keep = max((key for key in keys if key is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        for at, key in enumerate(sorted(keys, key=lambda key: (key != keep, str(key)))):
            found[key, keep, len(keys), at == 0, digest] += 1
    return found


COPIES = (
    [(at, f"text {at % 37} é") for at in range(200)]
    + [(1000 + at, "a third of all rows") for at in range(100)]
    + [(2000, ""), (2001, None), (None, None), (None, "only null ids"), (None, "only null ids")]
    + [(7, "same id"), (7, "same id"), (7, "another text"), (8, "x" * 300_000), (9, "x" * 300_000)]
    + [(10, "x" * 299_999 + "y"), (11, " a"), (12, "a"), (13, "A"), (14, "é"), (15, "é")]
)


@pytest.mark.parametrize("bits", [64, 6, 1])
@pytest.mark.parametrize("few", [100_000, 3])
def test_copies_equal_brute_force(spark, bits, few):
    frame = spark.createDataFrame([(*row, 1, "s", 2, "f", "v") for row in COPIES], TABLES).repartition(6)
    found = exact_copies.exact_copies(frame, bits=bits, segment=40, few=few)
    assert Counter(tuple(row) for row in found.collect()) == copies_of(COPIES)


def test_copies_after_normalising(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "c")]
    found = exact_copies.exact_copies(spark.createDataFrame(rows, "doc_id long, text string"), F.lower)
    assert {row.doc_id: row.keep_id for row in found.collect()} == {1: 2, 2: 2, 3: 3}


def test_copies_of_nothing(spark):
    assert exact_copies.exact_copies(spark.createDataFrame([], TABLES)).collect() == []


@pytest.mark.parametrize("bits", [1, 7, 16, 33, 64])
def test_filters_lose_nothing(bits):
    rng = random.Random(bits)
    known = [rng.getrandbits(bits) for _ in range(300)]
    met = [rng.choice(known) for _ in range(2000)]
    for segment_bits in {0, min(bits, 3)}:
        parts = []
        for own in (met[:700], met[700:1900], met[1900:]):
            prints, counts = np.unique(np.array(own, np.uint64), return_counts=True)
            batch = exact_copies._segments(prints, counts, bits, segment_bits)
            parts.append(batch.to_pylist())
        totals = Counter()
        for segment in {row["segment"] for rows in parts for row in rows}:
            own = [from_filter(row, bits) for rows in parts for row in rows if row["segment"] == segment]
            prints, counts = merged(own)
            again = from_filter(to_filter(prints, counts, bits, segment_bits, segment), bits)
            assert (again[0] == prints).all() and (again[1] == counts).all()
            assert (np.diff(prints.astype(object)) > 0).all()
            totals.update(dict(zip(prints.tolist(), counts.tolist())))
        assert totals == Counter(met)


def test_a_filter_is_smaller_than_its_fingerprints():
    prints = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64))
    row = to_filter(prints, np.ones(len(prints), np.int64), 64, 0, 0)
    assert sum(len(value) for value in row.values() if isinstance(value, bytes)) < 7 * len(prints)


# --- fill-in-middle


def infilled(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * at : 8 * at + 8], 16) for at in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", text, None, None
    if h[3] % 100 < 20:
        return key, n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return key, n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def test_infill_equals_brute_force(spark):
    rng = random.Random(3)
    pieces = ["word", "Ab", " ", "\n", "\r\n", "é", "\U0001f600", "<", "<P", "S>", ">", "$1", "\\", " ", "\x00", "{2}", "9"]
    rows = [(at, "".join(rng.choices(pieces, k=rng.randrange(0, 30)))) for at in range(600)]
    rows += [(700 + at, text) for at, text in enumerate(["<P>", "a<S>b", "<M>", "", None, "a", "<", "<P<S>"])]
    rows += [(None, "some text"), (5, rows[5][1]), (800, "ab é, " * 100_000), (801, "x" * 1_000_000), (802, "\n" * 300_000)]
    frame = spark.createDataFrame([(*row, 1, "s", 2, "f", "v") for row in rows], TABLES)
    found = fill_in_middle(frame).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = Counter((x.doc_id, x.n, x.form, x.output, x.prefix_chars, x.middle_chars) for x in found)
    assert got == Counter(infilled(*row) for row in rows)
    assert all(x.back == x.text for x in found)
    assert {x.form for x in found} == {"plain", "psm", "spm"}


def test_infill_of_nothing(spark):
    assert fill_in_middle(spark.createDataFrame([], TABLES)).collect() == []
