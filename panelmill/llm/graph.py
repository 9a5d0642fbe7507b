"""Connected components of a large edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.session import cut_lineage, drop_stored, shuffles_freed


class Forest:
    """Union-find over integers; the smallest member is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def _forest_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a partition by stars; flushed at a bounded number of nodes."""
    forest = Forest()

    def stars() -> pa.RecordBatch:
        nodes = [x for x in forest.parent if forest.root(x) != x]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], ["a", "b"]
        )

    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
        for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            forest.join(x, y)
        if len(forest.parent) > 1_000_000:
            yield stars()
            forest = Forest()
    yield stars()


def _settled(edges: DataFrame) -> tuple[int, bool]:
    """Number of nodes, and whether the edges are stars: no node has two edges, and no centre has one."""
    centres = edges.select(F.col("b").alias("a"), F.lit(2).alias("n")).distinct()
    seen = edges.select("a", F.lit(1).alias("n")).union(centres).groupBy("a").agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    with shuffles_freed(edges.sparkSession):
        nodes, several = seen.agg(F.count("*"), F.max((F.col("n") > F.col("m")).cast("int"))).first()
    return nodes, not several


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns ``node``, ``component`` (smallest node reachable) of all nodes that have an edge to another.

    ``edges``: two long columns, in any direction; loops and NULL ends are ignored. Alternates the large-star and
    small-star steps (each an aggregate and a join by node, so a node with very many edges is split by adaptive
    execution) until the edges are stars; every task replaces its edges by a forest, which drops repeated ones. Nothing is
    collected; every step is stored in the shared folder, in files of some 100,000 edges, and the one before it goes.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    current = cut_lineage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for number in range(rounds):
        nodes, done = _settled(current)
        if done:
            break

        def stored(step: DataFrame, files: int = 8 + nodes // 100_000) -> DataFrame:
            return cut_lineage(step.coalesce(files).mapInArrow(_forest_of_partition, "a long, b long"))

        if not number:
            given = current
            current = stored(given)
            drop_stored(given)
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        up = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, current = current, stored(up.union(low.select("a", F.col("m").alias("b"))))
        drop_stored(before, large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
