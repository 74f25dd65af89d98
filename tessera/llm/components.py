"""Connected components by repeated contraction, in joins and partial aggregates; a bounded rest in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Edges that one task works through (16 bytes each); more are contracted by joins until no more are left.
LOCAL_EDGES = 1 << 20


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and of each the least node of its component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[up]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (further := up[up]).tobytes() != up.tobytes():
            up = further


def _local(edges: DataFrame) -> DataFrame:
    """(node, label) of LOCAL_EDGES edges (a, b) at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if held:
            nodes, label = least_nodes(*(np.concatenate(x) for x in zip(*held)))
            yield pa.record_batch([pa.array(nodes), pa.array(label)], ["node", "label"])

    return edges.repartition(1).mapInArrow(run, "node long, label long")


def components(edges: DataFrame, *, local: int = LOCAL_EDGES) -> DataFrame:
    """(a, b) long edges -> (node, label): one label per component of the nodes that have an edge.

    While there are more than ``local`` edges, every node looks at itself and its neighbours and points at the one
    whose hash, salted by the round, is least; edges are then redrawn between the nodes pointed at. A constant share of
    the nodes goes each round whatever the graph's shape, so rounds grow with the logarithm of its size, and a node's
    neighbours meet in a partial minimum; hot nodes are split by the adaptive skew join. What is left goes to one task.
    Loops, null ends and repeated edges are harmless.
    """
    edges = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b"))
    steps: list[DataFrame] = []
    while edges.count() > local:
        if not steps:
            edges = cut(edges.union(edges.select("b", "a")).distinct())
        salt = len(steps) + 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), c.alias("v"))  # noqa: B023, E731
        to = edges.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        to = cut(to.select("node", F.least(F.col("m"), rank(F.col("node")))["v"].alias("label")))
        steps.append(to)
        ends = edges.join(to.select(F.col("node").alias("a"), F.col("label").alias("_a")), "a")
        ends = ends.join(to.select(F.col("node").alias("b"), F.col("label").alias("_b")), "b")
        edges = cut(ends.filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    onward = cut(_local(edges))
    # the rounds' steps one after the other, from the last, so that the larger frames are joined once
    for to in reversed(steps):
        after = onward.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        onward = cut(to.join(after, "label", "left").select("node", F.coalesce("_next", "label").alias("label")))
    return onward
