"""Connected components of a graph given by edges, with hot nodes and long chains.

Alternates two steps on directed edges until nothing changes: every node sends its larger
neighbours, and then its smaller ones, to the smallest node it knows. Minima are combined on the map
side and joined back, so adaptive execution can split a node with very many edges; a round's edges
never outnumber those of the round before by more than the nodes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from newslens.llm.stored import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b) with a > b: neighbours of a node move to its smallest neighbour."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")).withColumnRenamed("a", "node")
    joined = around.join(least, around["a"] == least["node"])
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("low").alias("b"))
        )
    return moved.filter("a > b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node it can reach.

    Self links and repeated edges are harmless, edges with a null end link nothing, and no edges
    give no rows.
    """
    linked = edges.filter("a is not null and b is not null and a <> b")
    current = stored(
        linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        seen = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if tuple(seen) == mark or not seen["n"]:
            break
        mark = tuple(seen)
        current = stored(_star(_star(current, True), False), "edges")
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    # Settled edges are stars: every node points to the smallest of its component.
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def roots(labels: np.ndarray) -> np.ndarray:
    """Follow parents to the root for all nodes at once."""
    while True:
        up = labels[labels]
        if np.array_equal(up, labels):
            return labels
        labels = up


def unite(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge the sets of ``left[i]`` and ``right[i]``; ``labels`` holds roots before and after."""
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        labels = roots(labels)
    return labels
