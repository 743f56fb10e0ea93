"""Connected components of an edge table, without ever gathering the edges in one place."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerbrook.llm.common import lean, shared

#: Nodes that a task joins at a time.
NODES = 1_000_000


def _contract(batches):
    """Replace a partition's edges by a star for each of its local components, ``NODES`` or so at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars():
        nodes = [x for x in parent if root(x) != x]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > NODES:
            yield from stars()
            parent.clear()
    yield from stars()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v longs); root is the component's smallest node.

    Each partition first contracts its edges to stars; then large-star and small-star rounds run until every edge points
    to a root. Rounds grow with the logarithm of the number of nodes. Each round's edges are written to shared storage.
    """
    edges = edges.where("u <> v").select("u", "v")
    edges = shared(edges.mapInArrow(lean(_contract), "u long, v long").distinct())
    for _ in range(max_rounds):
        # an edge (u, v) has v < u; the work is done when no v has a smaller neighbour itself, so all are stars
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        after = shared(after.mapInArrow(lean(_contract), "u long, v long").distinct())
        moved = after.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        still = edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if tuple(moved) == tuple(still):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
