"""Embedding near-duplicates: an exact metric range join in cells around pivots.

Vectors of length one with a cosine of at least c are at most r = sqrt(2 - 2c)
apart. Each vector has its home in the cell of its nearest pivot. A vector can only
be within r of the home of a cell whose border is within r of it, by the triangle
inequality in the direction between both pivots; there it is replicated. A pair
is compared in the lower of its two home cells, so a vector goes to lower cells
only. Cells are joined independently: each is split into blocks of bounded size,
and what is compared with a block streams past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.components import components, lowest_labels
from tallywright.llm.tasks import arrow_map, batch
from tallywright.sources.scratch import stage

COSINE = 0.95
#: Vectors of a block, and about as many vectors per pivot.
BLOCK = 4096
MOST_PIVOTS = 512
#: Columns of one comparison.
STRIP = 1024
#: Rounding that bounds may have.
SLACK = 1e-6


def _unit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length one; those that can't be linked are left out."""
    for part in parts:
        rows = part.column("embedding").to_pylist()
        kept, units = [], []
        for at, row in enumerate(rows):
            if not row or None in row:
                continue
            vector = np.array(row, np.float64)
            largest = np.abs(vector).max()
            if not np.isfinite(vector).all() or largest == 0:
                continue
            vector = vector / largest
            kept.append(at)
            units.append((vector / np.sqrt(vector @ vector)).tobytes())
        yield batch(
            vec_id=part.column("vec_id").take(pa.array(kept, pa.int64())),
            unit=pa.array(units, pa.binary()),
        )


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _home(pivots, distance: float):
    """Each vector with its home cell and the lower cells it is replicated to."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            units = part.column("unit").to_pylist()
            homes, cells = [], []
            for unit in units:
                vector = np.frombuffer(unit, np.float64)
                known, apart = pivots.value.get(len(vector), (None, None))
                if known is None or not len(known):
                    homes.append(0)
                    cells.append([])
                    continue
                cosines = known @ vector
                home = int(np.argmax(cosines))
                # |x - p|^2 - |x - q|^2 over 2 |p - q| is how far x is from the border of p and q
                beyond = (cosines[home] - cosines[:home]) / np.maximum(apart[home, :home], SLACK)
                homes.append(home)
                cells.append(np.flatnonzero(beyond <= distance + SLACK).tolist())
            yield batch(
                class_id=part.column("class_id"),
                weight=part.column("weight"),
                unit=part.column("unit"),
                dims=np.array([len(unit) // 8 for unit in units], np.int32),
                home=np.array(homes, np.int32),
                cells=pa.array(cells, pa.list_(pa.int32())),
            )

    return run


class _Block:
    """The vectors at home in a block, and the links found with them."""

    def __init__(self, cosine: float) -> None:
        self.cosine = cosine
        self.ids: list[int] = []
        self.units: list[bytes] = []
        self.weights: list[int] = []
        self.vectors: np.ndarray | None = None
        self.links = np.empty(0, np.int64)

    def add(self, ids: list[int], weights: list[int], units: list[bytes]) -> None:
        self.ids += ids
        self.weights += weights
        self.units += units

    def close(self) -> Iterator[pa.RecordBatch]:
        """Compare the block with itself."""
        self.vectors = _matrix(self.units)
        self.known = np.array(self.ids, np.int64)
        self.weight = np.array(self.weights, np.int64)
        self.links = np.zeros(len(self.ids), np.int64)
        for low in range(0, len(self.known), STRIP):
            close = self.vectors[low:] @ self.vectors[low : low + STRIP].T >= self.cosine
            rows, columns = np.nonzero(np.tril(close, -1))
            self._count(self.links, rows + low, self.weight[columns + low])
            self._count(self.links, columns + low, self.weight[rows + low])
            yield from self._forest(rows + low, columns + low, self.known)

    def meet(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Compare the block with vectors that are not at home in it."""
        for low in range(0, len(ids), STRIP):
            theirs = ids[low : low + STRIP]
            close = self.vectors @ vectors[low : low + STRIP].T >= self.cosine
            rows, columns = np.nonzero(close)
            if len(rows):
                self._count(self.links, rows, weights[low:][columns])
                links = np.zeros(len(theirs), np.int64)
                self._count(links, columns, self.weight[rows])
                linked = np.flatnonzero(links)
                yield _found(theirs[linked], links[linked])
                yield from self._forest(rows, columns + len(self.known), np.concatenate([self.known, theirs]))

    @staticmethod
    def _count(links: np.ndarray, at: np.ndarray, weights: np.ndarray) -> None:
        links += np.bincount(at, weights, len(links)).astype(np.int64)

    def _forest(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(left):
            label = lowest_labels(left, right, len(ids))
            moved = np.flatnonzero(label != np.arange(len(ids)))
            yield _found(ids[moved], np.zeros(len(moved), np.int64), ids[label[moved]])

    def end(self) -> Iterator[pa.RecordBatch]:
        linked = np.flatnonzero(self.links)
        yield _found(self.known[linked], self.links[linked])


def _found(ids: np.ndarray, links: np.ndarray, roots: np.ndarray | None = None) -> pa.RecordBatch:
    root = pa.nulls(len(ids), pa.int64()) if roots is None else pa.array(roots, pa.int64())
    return batch(class_id=ids, links=links, root=root)


def _join(cosine: float):
    """Rows by block, those at home first: counts of links, and links that span groups."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block = None, None
        for part in parts:
            names = [part.column(name).to_numpy(zero_copy_only=False) for name in ("dims", "cell", "block", "guest")]
            keys = np.stack([x.astype(np.int64) for x in names], axis=1)
            ids, weights = (part.column(name).to_numpy() for name in ("class_id", "weight"))
            units = part.column("unit").to_pylist()
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            edges = [0, *changes.tolist(), len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                *key, guest = keys[low].tolist()
                if key != current:
                    if block is not None and block.ids:
                        if block.vectors is None:
                            yield from block.close()
                        yield from block.end()
                    current, block = key, _Block(cosine)
                if not guest:
                    block.add(ids[low:high].tolist(), weights[low:high].tolist(), units[low:high])
                elif block.ids:
                    if block.vectors is None:
                        yield from block.close()
                    yield from block.meet(ids[low:high], weights[low:high], _matrix(units[low:high]))
        if block is not None and block.ids:
            if block.vectors is None:
                yield from block.close()
            yield from block.end()

    return run


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings``.

    ``n_links`` counts the other vectors with at least that cosine, in double
    precision, ``component_id`` is the smallest ``vec_id`` that links reach, and
    ``kept`` tells whether that is the row's own.

    Vectors that are null, empty, zero, or hold a null or non-finite component are linked
    with nothing; vectors of different lengths aren't compared. Rows of equal vectors are
    linked with each other, also if a ``vec_id`` is repeated. A row with a null
    ``vec_id`` counts as a link, and its component is null if it reaches no other. Other
    columns are ignored, an empty table gives no rows.

    The pivots are a bounded sample: one per ``block`` vectors, ``MOST_PIVOTS`` at most.
    """
    spark = embeddings.sparkSession
    units = stage(
        arrow_map(embeddings.select("vec_id", "embedding"), _unit, "vec_id long, unit binary"), "units"
    )
    equal = (
        units.groupBy("unit")
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
        .withColumn("class_id", F.xxhash64("unit"))
    )
    equal = stage(equal, "equal")
    sizes = equal.groupBy(F.length("unit").alias("bytes")).count().collect()
    pivots = {}
    for size, count in sizes:
        most = min(MOST_PIVOTS, -(-count // block))
        chosen = equal.where(F.length("unit") == size).orderBy(F.xxhash64("class_id"), "class_id").limit(most)
        known = _matrix([row[0] for row in chosen.select("unit").collect()])
        apart = np.sqrt(np.maximum(2 - 2 * known @ known.T, 0))
        pivots[size // 8] = known, apart
    distance = float(np.sqrt(2 - 2 * cosine))
    homes = stage(
        arrow_map(
            equal.select("class_id", "weight", "unit"),
            _home(spark.sparkContext.broadcast(pivots), distance),
            "class_id long, weight long, unit binary, dims int, home int, cells array<int>",
        ),
        "homes",
    )
    # One row per cell, so bounded by the number of pivots.
    blocks = homes.groupBy("dims", F.col("home").alias("cell")).agg(
        F.expr(f"cast(ceil(count(*) / {block}) as int)").alias("blocks")
    )
    blocks = F.broadcast(spark.createDataFrame(blocks.collect(), "dims int, cell int, blocks int"))
    own = homes.withColumn("cell", F.col("home")).join(blocks, ["dims", "cell"])
    own = own.withColumn("block", F.expr("cast(pmod(xxhash64(class_id, 7), blocks) as int)"))
    at_home = own.selectExpr("class_id", "weight", "unit", "dims", "cell", "block", "0 as guest")
    beside = own.where("block > 0").selectExpr(
        "class_id", "weight", "unit", "dims", "cell", "explode(sequence(0, block - 1)) as block", "1 as guest"
    )
    abroad = (
        homes.selectExpr("class_id", "weight", "unit", "dims", "explode(cells) as cell")
        .join(blocks, ["dims", "cell"])
        .selectExpr(
            "class_id", "weight", "unit", "dims", "cell", "explode(sequence(0, blocks - 1)) as block", "1 as guest"
        )
    )
    rows = (
        at_home.union(beside).union(abroad)
        .repartition("dims", "cell", "block")
        .sortWithinPartitions("dims", "cell", "block", "guest")
    )
    found = stage(arrow_map(rows, _join(cosine), "class_id long, links long, root long"), "found")
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    groups = components(found.where("root is not null").selectExpr("class_id as a", "root as b"))
    named = (
        groups.join(equal, groups.node == equal.class_id)
        .groupBy("component")
        .agg(F.min("first_id").alias("group_id"))
    )
    grouped = groups.join(named, "component").selectExpr("node as class_id", "group_id")
    of_class = (
        equal.join(counts, "class_id", "left")
        .join(grouped, "class_id", "left")
        .selectExpr(
            "unit as of_unit",
            "weight - 1 + coalesce(links, 0) as n_links",
            "coalesce(group_id, first_id) as component_id",
        )
    )
    linked = units.join(of_class, units.unit == of_class.of_unit).select("vec_id", "n_links", "component_id")
    return _with_unlinked(embeddings, linked)


def _with_unlinked(embeddings: DataFrame, linked: DataFrame) -> DataFrame:
    """Add the rows whose vectors can't be linked."""
    bad = embeddings.where(
        "embedding is null or size(embedding) = 0 "
        "or exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) "
        "or forall(embedding, x -> x = 0)"
    )
    alone = bad.selectExpr("vec_id", "0L as n_links", "vec_id as component_id")
    return linked.union(alone).withColumn("kept", F.expr("vec_id <=> component_id"))
