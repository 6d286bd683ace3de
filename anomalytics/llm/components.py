"""Connected components: forests of blocks of edges, then alternating large-star and small-star steps.

A task turns each block of at most ``block`` edges into stars around the least nodes, without a shuffle. Stars of one
block are the components; the stars of several blocks are joined by large-star and small-star steps. Each step replaces
edges by edges to the smallest neighbour, found with a partial aggregation before the shuffle, so a node with very many
edges is never gathered in one task. The number of rounds grows with the logarithm of the size of a component, not with
its diameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalytics.llm.common import discard, free_worker, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node tells its larger neighbours the least of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node tells its smaller neighbours and itself the least of them. Edges come as (larger, smaller)."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("x"), "m")
    return (out.unionByName(least.select(F.col("a").alias("x"), "m")).where("x <> m").distinct()
            .select(F.col("x").alias("a"), F.col("m").alias("b")))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not the least of its component, for the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, np.concatenate([root[x], root[y]]), np.concatenate([low, low]))
        while (root[root] != root).any():
            root = root[root]
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]


def _block_forests(edges: DataFrame, block: int) -> DataFrame:
    """Edges (a, b) with a > b and the same components; a task holds ``block`` edges at a time."""
    def run(batches):
        free_worker()
        held, size = [], 0

        def stars():
            node, root = forest(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_pydict({"a": node, "b": root})

        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                if held and size + part.num_rows > block:
                    yield stars()
                    held, size = [], 0
                held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
                size += part.num_rows
        if held:
            yield stars()

    return edges.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(node, component): the least node that is reachable, for every node of an edge (a, b)."""
    edges = materialize(edges.select("a", "b").where("a <> b"), "edges")
    blocks = -(-edges.count() // block)
    now = materialize(_block_forests(edges.coalesce(max(1, blocks)), block), "edges")
    discard(edges)
    state = None
    while blocks > 1:
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
