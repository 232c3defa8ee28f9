"""Connected components over a table of links, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlake.llm.store import drop, settle, small_batches, with_groups

#: Up to so many links (16 bytes each) are joined by one task; more of them in rounds over all tasks.
FEW = 100_000


class Forest:
    """Union-find; the least member names a tree."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = list(forest.parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["node", "component"])


def _stars(links: DataFrame) -> bool:
    """Whether every node ``u`` has one link, to a node that has none of its own: then each tree is a star on its least node."""
    own = links.groupBy(F.col("u").alias("k")).agg(F.count("*").alias("n"))
    named = links.select(F.col("v").alias("k")).distinct().withColumn("named", F.lit(True))
    return own.join(named, "k", "left").where("n > 1 or named").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link.

    ``edges`` has columns ``a`` and ``b`` and should be a settled table. Up to FEW
    links are joined by one task, as rounds over them would only start and end tasks;
    beyond that, the work is dealt over all tasks: alternating large-star and small-star
    steps (Kiveris et al. 2014): each step moves every neighbour of a node to the
    least of them, so the number of rounds grows with the logarithm of the
    longest path; it ends when only stars are left. Minima are pre-aggregated
    before the shuffle, a node with very many links is dealt over all tasks, and
    nothing but row counts comes to the driver. Self-links and
    repeated links change nothing; without links the result is empty. The result
    reads a settled table of its own.
    """
    links = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    if links.limit(FEW + 1).count() <= FEW:
        small_batches(edges.sparkSession)
        return settle(links.coalesce(1).mapInArrow(_joined, "node long, component long"))
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = with_groups(both, ["u"], m=F.min("v")).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = settle(least.distinct())
        drop(now)
        small = with_groups(large, ["u"], m=F.min("v"))
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = settle(moved.distinct())
        drop(large)
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._raterlake_path = now._raterlake_path  # for drop()
    return out
