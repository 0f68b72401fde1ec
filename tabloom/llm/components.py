"""Connected components by contraction, with every round written to the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _roots(parents: DataFrame, tag: str) -> DataFrame:
    """(node, parent) with every parent replaced by the end of its chain, by pointer doubling."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        after = shared.settle(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") < F.col("parent")).alias("moved")), f"{tag}-up")
        shared.discard(parents)
        parents = after
        if parents.where("moved").isEmpty():
            return parents


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and for each the smallest node reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))  # never above its node, so the end of a chain is its smallest
    while len(x):
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return nodes, nodes[parent]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, parent) with the smallest node reachable as parent, for ``edges`` that are few: a task holds them all."""

    def run(batches):
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, low = _smallest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "parent": pa.array(low, pa.int64())})
        shared.trim(encoders=False)

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, parent long")


def _renamed(named: DataFrame | None, parents: DataFrame) -> DataFrame:
    """(node, component) after the components of ``named`` (None: the nodes themselves) have met in ``parents``."""
    if named is None:
        out = parents.select("node", F.col("parent").alias("component"))
        out._settled_at = getattr(parents, "_settled_at", None)
        return out
    return named.join(parents.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))


def components(edges: DataFrame, tag: str = "components", most_rounds: int = 100, few: int = 0) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (columns a, b), for each node that has an edge.

    Each round lets every node follow its smallest neighbour, follows these chains to their ends, and contracts the graph to
    the ends; at least half of the nodes go, and of many edges within a group one join is all that is made. Nothing is
    gathered on the driver but counts. Rows that share a hot node are combined before they are shuffled, or meet one
    row of the other side in a join whose skewed partitions Spark splits. Null ends and loops are ignored. No edges give no rows.

    Once at most ``few`` edges are left, a single task of Python does the rest (nodes are longs then): every round is some ten
    queries, and what planning and serving them takes of the driver doesn't fall with the edges."""
    ends = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left, named = shared.settle(ends.distinct(), f"{tag}-edges"), None
    for _ in range(most_rounds):
        n = left.count() if few or named is not None else 1
        if not n and named is not None:
            shared.discard(left)
            return named
        if n <= few:
            parents = shared.settle(_in_one_task(left), f"{tag}-parents")
            now = _renamed(named, parents) if named is None else shared.settle(_renamed(named, parents), f"{tag}-named")
            shared.discard(left, *([parents, named] if named is not None else []))
            return now
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        parents = shared.settle(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("parent")), f"{tag}-parents")
        parents = _roots(parents, tag)
        now = shared.settle(_renamed(named, parents), f"{tag}-named")
        x, y = (parents.select(F.col("node").alias(s), F.col("parent").alias(f"p{s}")) for s in "ab")
        over = left.join(x, "a").join(y, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        over = shared.settle(over.distinct(), f"{tag}-edges")
        shared.discard(left, parents, *([named] if named is not None else []))
        left, named = over, now
    raise RuntimeError("components did not settle")
