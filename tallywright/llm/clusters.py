"""Centroid clustering: exact k-means, with an n-simplex projection to rule centroids out.

The distances of a vector to n pivots make it the apex of a simplex whose base the
pivots are. Its coordinates there need no more than those distances and are cached: the
first ones place the apex above the base, the last one is its height. The pivots are
the centroids of an earlier round, taken anew once the centroids have left their base. Two apexes are
nearest to each other if both stand on the same side of the base and farthest if they
stand on opposite sides, so their distances are a lower and an upper bound of the
distance between the vectors. Each round projects the centroids, and a centroid whose
lower bound exceeds another one's upper bound is out. Those left are compared in
integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.tasks import arrow_map, batch
from tallywright.sources.scratch import stage

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Distances to new pivots are cached once centroids stand higher above the base than
#: this share of their largest distance. It decides how much is ruled out, never the result.
HIGH = 0.1
#: A pivot less high above the others, as a share of the largest distance, is left out.
LEAST_HEIGHT = 0.05
#: Condition that a base may have. An apex is then placed to 1e-10 of its length, and its
#: height, the root of a difference, to 1e-5.
WORST_CONDITION = 1e4
#: Rounding that bounds may have, as a share of the squared lengths they are made of.
SLACK = 1e-4
#: Integers below this keep every squared distance within 63 bits.
NARROW = 1 << 27
#: More than any squared distance of doubles.
BEYOND = 1 << 4096
_LIMB = 32


def integers(vector: list) -> list[int]:
    """``floor(SCALE * x)`` of each component, exactly."""
    # a float of this size has no fraction left, and scaling it could overflow
    return [int(x) * SCALE if abs(x) >= 2.0**52 else int(np.floor(x * SCALE)) for x in vector]


def _quantised(dimensions: int):
    """The kept vectors as integers: 32 bits each, or decimal text where these are too few."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column("embedding")
            sized = np.array(
                [size == dimensions for size in column.value_lengths().to_pylist()], bool
            )
            rows = column.filter(pa.array(sized))
            flat = rows.flatten()
            holes = np.asarray(flat.is_null()).reshape(-1, dimensions)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            fit = ~holes.any(axis=1) & np.isfinite(values).all(axis=1)
            values = values[fit]
            narrow = (np.abs(values) < NARROW // SCALE).all(axis=1)
            small = np.floor(np.where(narrow[:, None], values, 0) * SCALE).astype("<i4")
            cells = [
                small[at].tobytes() if narrow[at] else ",".join(map(str, integers(values[at]))).encode()
                for at in range(len(values))
            ]
            yield batch(
                vec_id=part.column("vec_id").filter(pa.array(sized)).filter(pa.array(fit)),
                vector=pa.array(cells, pa.binary()),
                narrow=pa.array(narrow, pa.bool_()),
            )

    return run


def unpacked(vector: bytes, narrow: bool) -> list[int]:
    return np.frombuffer(vector, "<i4").tolist() if narrow else [int(x) for x in vector.split(b",")]


class Simplex:
    """A base of pivots, and the places of vectors above it by their distances to the pivots."""

    def __init__(self, pivots: np.ndarray) -> None:
        """Take the pivots that stand high enough above those before them."""
        squares = _squares(pivots, pivots)
        largest = squares.max() if len(pivots) else 0.0
        chosen: list[int] = []
        rows: list[np.ndarray] = []
        while len(chosen) < len(pivots):
            best = 0
            if chosen:
                places = self.apexes(squares[:, chosen])
                best = int(np.argmax(places[:, -1]))
                if places[best, -1] ** 2 <= LEAST_HEIGHT**2 * largest:
                    break
                rows.append(places[best])
            chosen.append(best)
            self._base(rows, squares[chosen, chosen[0]])
            if rows and np.linalg.cond(self.edges) > WORST_CONDITION:
                chosen.pop()
                rows.pop()
                break
        self.pivots = pivots[chosen]
        self._base(rows, squares[chosen, chosen[0]] if chosen else np.empty(0))

    def _base(self, rows: list[np.ndarray], squares: np.ndarray) -> None:
        """Lower triangle of the pivots' own coordinates, the first pivot at the origin."""
        size = len(rows)
        self.edges = np.zeros((size, size))
        for at, row in enumerate(rows):
            self.edges[at, : at + 1] = row[: at + 1]
        self.lengths = squares[1 : size + 1]

    def apexes(self, squares: np.ndarray) -> np.ndarray:
        """Coordinates of vectors by their squared distances to the pivots; the last one is the height."""
        size = len(self.edges)
        places = np.zeros((len(squares), size + 1))
        for at in range(size):
            known = places[:, :at] @ self.edges[at, :at]
            target = (squares[:, 0] + self.lengths[at] - squares[:, at + 1]) / 2
            places[:, at] = (target - known) / self.edges[at, at]
        below = (places[:, :size] ** 2).sum(axis=1)
        places[:, size] = np.sqrt(np.maximum(squares[:, 0] - below, 0))
        return places

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return self.apexes(_squares(vectors, self.pivots))


def _squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances as doubles, of whole numbers below ``NARROW``."""
    found = np.empty((len(left), len(right)))
    for at, row in enumerate(right):
        found[:, at] = ((left - row) ** 2).sum(axis=1)
    return found


def bounds(apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances, with room for rounding."""
    base = np.zeros((len(apexes), len(centres)))
    for at, centre in enumerate(centres):
        base[:, at] = ((apexes[:, :-1] - centre[:-1]) ** 2).sum(axis=1)
    lengths = (apexes**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)
    low = base + (apexes[:, -1:] - centres[:, -1]) ** 2
    high = base + (apexes[:, -1:] + centres[:, -1]) ** 2
    return low - SLACK * lengths, high + SLACK * lengths


def nearest(
    vectors: np.ndarray, centroids: list[list[int]], apexes: np.ndarray | None, simplex: Simplex
) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector, ties to the smaller number, and how many were compared.

    ``vectors`` are 64-bit integers below ``NARROW``, or Python's own if ``apexes`` is None.
    """
    narrow = [max(map(abs, centroid)) < NARROW for centroid in centroids]
    left = np.ones((len(vectors), len(centroids)), bool)
    if apexes is not None and any(narrow) and len(simplex.pivots):
        at = np.flatnonzero(narrow)
        centres = simplex.project(np.array([centroids[x] for x in at], np.float64))
        low, high = bounds(apexes, centres)
        left[:, at] = low <= high.min(axis=1)[:, None]
    found = np.zeros(len(vectors), np.int64)
    alone = left.sum(axis=1) == 1
    found[alone] = left[alone].argmax(axis=1)
    rest = np.flatnonzero(~alone)
    exact = vectors.dtype != object and all(narrow)
    best = np.full(len(rest), np.iinfo(np.int64).max) if exact else np.full(len(rest), BEYOND, object)
    compared = 0
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero(left[rest, number])
        apart = distances(vectors[rest[rows]], centroid)
        nearer = (apart < best[rows]).astype(bool)
        best[rows[nearer]] = apart[nearer]
        found[rest[rows[nearer]]] = number
        compared += len(rows)
    return found, compared


def distances(vectors: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances, as Python integers where 64 bits may not hold them."""
    if vectors.dtype == object or max(map(abs, centroid)) >= NARROW:
        apart = vectors.astype(object) - np.array(centroid, object)
    else:
        apart = vectors - np.array(centroid, np.int64)
    return (apart * apart).sum(axis=1)


def _matrix(part: pa.RecordBatch, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Row numbers, integers and apexes of a batch's vectors, either the narrow ones or the others."""
    rows = np.flatnonzero(np.asarray(part.column("narrow")) == narrow)
    cells = part.column("vector").take(pa.array(rows)).to_pylist()
    if not narrow or not len(rows):
        return rows, np.array([unpacked(cell, False) for cell in cells], object), None
    vectors = np.frombuffer(b"".join(cells), "<i4").reshape(len(cells), -1).astype(np.int64)
    if part.column("apex").null_count == part.num_rows:  # no centroid was fit to be a pivot
        return rows, vectors, None
    apexes = part.column("apex").take(pa.array(rows)).to_pylist()
    return rows, vectors, np.frombuffer(b"".join(apexes), np.float64).reshape(len(cells), -1)


def _with_apexes(simplex: Simplex):
    """Cache each narrow vector's place above the pivots."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            narrow = part.column("narrow").to_pylist()
            apexes = [None] * len(narrow)
            rows = np.flatnonzero(narrow)
            cells = part.column("vector").take(pa.array(rows)).to_pylist()
            if len(rows) and len(simplex.pivots):
                vectors = np.frombuffer(b"".join(cells), "<i4").reshape(len(cells), -1)
                for row, place in zip(rows, simplex.project(vectors.astype(np.float64))):
                    apexes[row] = place.tobytes()
            yield batch(
                vec_id=part.column("vec_id"),
                vector=part.column("vector"),
                narrow=part.column("narrow"),
                apex=pa.array(apexes, pa.binary()),
            )

    return run


def _sums(centroids: list[list[int]], simplex: Simplex):
    """Per task, cluster and component: the sum of its vectors, in limbs; component -1 counts them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for part in parts:
            for narrow in (True, False):
                _, vectors, apexes = _matrix(part, narrow)
                if not len(vectors):
                    continue
                found, _ = nearest(vectors, centroids, apexes, simplex)
                for cluster in np.unique(found).tolist():
                    own = vectors[found == cluster]
                    sums = [len(own), *own.sum(axis=0).tolist()]
                    for at, value in enumerate(sums, -1):
                        totals[cluster, at] = totals.get((cluster, at), 0) + int(value)
        rows = [
            (cluster, at, limb, value)
            for (cluster, at), total in totals.items()
            for limb, value in enumerate(_limbs(total))
        ]
        table = np.array(rows, np.int64).reshape(-1, 4)
        yield batch(
            cluster=table[:, 0].astype(np.int32),
            component=table[:, 1].astype(np.int32),
            limb=table[:, 2].astype(np.int32),
            total=table[:, 3],
        )

    return run


def _limbs(value: int) -> list[int]:
    """Digits of 32 bits with the sign of the number, the lowest first."""
    sign, value, found = (-1 if value < 0 else 1), abs(value), []
    while value or not found:
        found.append(sign * (value & ((1 << _LIMB) - 1)))
        value >>= _LIMB
    return found


def _assign(centroids: list[list[int]], simplex: Simplex):
    """Cluster of each vector and its squared distance, null beyond 63 bits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            clusters = np.zeros(part.num_rows, np.int32)
            apart: list[int | None] = [None] * part.num_rows
            for narrow in (True, False):
                rows, vectors, apexes = _matrix(part, narrow)
                if not len(rows):
                    continue
                found, _ = nearest(vectors, centroids, apexes, simplex)
                clusters[rows] = found
                for cluster in np.unique(found).tolist():
                    own = np.flatnonzero(found == cluster)
                    for row, value in zip(rows[own].tolist(), distances(vectors[own], centroids[cluster]).tolist()):
                        apart[row] = _long(value)
            yield batch(vec_id=part.column("vec_id"), cluster=clusters, distance=pa.array(apart, pa.int64()))

    return run


def _long(value: int | None) -> int | None:
    return None if value is None or value >= 1 << 63 else int(value)


def moved(vectors: DataFrame, centroids: list[list[int]], simplex: Simplex) -> list[list[int]]:
    """The centroids after a round: the floors of their vectors' means; empty ones stay."""
    # A row per cluster, component, limb and task; what comes back has one per limb.
    sums = (
        arrow_map(vectors, _sums(centroids, simplex), "cluster int, component int, limb int, total long")
        .groupBy("cluster", "component", "limb")
        .agg(F.sum("total"))
        .collect()
    )
    totals: dict[int, dict[int, int]] = {}
    for cluster, component, limb, total in sums:
        own = totals.setdefault(cluster, {})
        own[component] = own.get(component, 0) + (total << (_LIMB * limb))
    return [
        [totals[at][x] // totals[at][-1] for x in range(len(centroid))] if at in totals else centroid
        for at, centroid in enumerate(centroids)
    ]


def base_of(centroids: list[list[int]]) -> Simplex:
    """A base of the centroids themselves: with no height, both bounds of a distance to one meet."""
    narrow = [centroid for centroid in centroids if max(map(abs, centroid)) < NARROW]
    return Simplex(np.array(narrow, np.float64).reshape(-1, len(centroids[0])))


def is_far(centroids: list[list[int]], simplex: Simplex) -> bool:
    """Whether centroids stand so high above a base that its bounds say little."""
    narrow = [centroid for centroid in centroids if max(map(abs, centroid)) < NARROW]
    if not narrow or not len(simplex.pivots):
        return bool(narrow)
    points = np.array(narrow, np.float64)
    return simplex.project(points)[:, -1].max() > HIGH * np.sqrt(_squares(points, points).max())


def cluster_vectors(
    embeddings: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    seed: str = SEED,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite; each
    component x counts as the integer ``floor(1024 * x)``. The vectors with the
    smallest hash of ``seed`` and ``vec_id`` are the first centroids. In each round every
    vector goes to the nearest centroid, ties to the smaller number, and every centroid
    that has vectors becomes the floor of their mean. All of it is exact in integers,
    so neither pivots nor partitioning can change the result.

    Rows count as often as they occur. Rows with a null ``vec_id`` are kept and start a
    cluster only after all others; rows that share a ``vec_id`` start one in the order
    of their components. Of fewer vectors than ``clusters`` each starts one. Components
    of any size are exact; a distance or sum beyond 63 bits is null. Other columns are
    ignored, an empty table gives no rows.

    Only centroids reach the driver.
    """
    spark = embeddings.sparkSession
    doubles = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    vectors = stage(
        arrow_map(doubles, _quantised(dimensions), "vec_id long, vector binary, narrow boolean"), "vectors"
    )
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(draw.asc_nulls_last(), "vector").limit(clusters).collect()
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result)
    centroids = [unpacked(row["vector"], row["narrow"]) for row in first]
    simplex = placed = None
    for left in range(rounds, -1, -1):
        if simplex is None or is_far(centroids, simplex):
            simplex = base_of(centroids)
            cached = arrow_map(
                vectors, _with_apexes(simplex), "vec_id long, vector binary, narrow boolean, apex binary"
            )
            placed = stage(cached, "apexes")
        if left:
            centroids = moved(placed.select("vector", "narrow", "apex"), centroids, simplex)
    assigned = stage(
        arrow_map(placed, _assign(centroids, simplex), "vec_id long, cluster int, distance long"), "assigned"
    )
    sums = (
        assigned.groupBy("cluster")
        .agg(
            F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
            F.expr("count(*) = count(distance)").alias("whole"),
        )
        .collect()
    )
    inertia = {row["cluster"]: int(row["s"]) if row["whole"] else None for row in sums}
    whole = None if None in inertia.values() else sum(inertia.values())
    rows = [
        (
            cluster,
            _long(own),
            _long(whole),
            hashlib.sha256(",".join(map(str, centroids[cluster])).encode()).hexdigest(),
        )
        for cluster, own in inertia.items()
    ]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(*(x.split()[0] for x in result.split(", ")))
