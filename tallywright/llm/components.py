"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.tasks import arrow_map, batch
from tallywright.sources.scratch import stage


def lowest_labels(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """The smallest node of each one's component, in a small graph of nodes 0 to count - 1."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[left], label[right])
        following = label.copy()
        for ends in (left, right, label[left], label[right]):
            np.minimum.at(following, ends, low)
        following = following[following]
        if np.array_equal(following, label):
            return label
        label = following


def roots_of(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a small graph and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    label = lowest_labels(ends[: len(left)], ends[len(left) :], len(nodes))
    return nodes, nodes[label]


def _contract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of each batch by one link from each node to its root."""
    for part in parts:
        left, right = (part.column(name).to_numpy() for name in ("a", "b"))
        nodes, roots = roots_of(left, right)
        moved = nodes != roots
        yield batch(node=nodes[moved], root=roots[moved])


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one root, and no root has a root of its own."""
    ends = stars.selectExpr("inline(array(struct(node as u, root as v), struct(root as u, cast(null as bigint) as v)))")
    torn = ends.groupBy("u").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.bool_or(F.col("v").isNull()).alias("head")
    )
    return torn.where("low <> high or (head and low is not null)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (long columns ``a``, ``b``).

    The component is the smallest node reachable. Nodes that have no link are not
    returned; an empty input gives no rows. Repeated links and loops do no harm,
    links with a null end are ignored. Each round is written to the shared folder,
    and the number of rounds grows with the logarithm of the longest path. Links that
    are stars from the start take no round.

    Both directions of a link, and both links that a round makes of one, are rows of one
    pass: a union would plan and run all that comes before it twice.
    """
    links = edges.select("a", "b").where("a is not null and b is not null")
    stars = stage(arrow_map(links, _contract, "node long, root long").distinct(), "stars")
    # A root is always smaller than its node.
    while not _settled(stars):
        both = stars.selectExpr("inline(array(struct(node as u, root as v), struct(root as u, node as v)))")
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").selectExpr("v as node", "m as root")
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = (
            large.join(least, "node")
            .selectExpr("inline(array(struct(root as node, m as root), struct(node as node, m as root)))")
            .where("node <> root")
        )
        stars = stage(small.distinct(), "stars")
    heads = stars.select("root").distinct()
    return stars.union(heads.select("root", "root")).toDF("node", "component")
