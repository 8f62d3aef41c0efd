"""Connected components of an edge table by alternating large-star and small-star rounds.

Everything stays in DataFrames written to the shared folder each round; nothing is collected but two
numbers a round. Neighbourhood minima are partial aggregates, so a node with very many neighbours is
no burden on one task; the minima are written before the join that spreads them, so that Spark can split
that join where it is skewed. A table of up to ``WHOLE`` edges is one task's instead: a round shuffles
about eight times, which for so few rows is nearly all overhead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import Scratch, released, ship

WHOLE = 1 << 20
"""Edges that one task takes whole: 16 MB."""


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, ascending, and the least node that each one reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        found = least_reachable(*(np.concatenate(c) for c in zip(*held, strict=True)))
        for i in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)], pa.int64()) for c in found], names=["node", "root"])


def _large_star(edges: DataFrame, put) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return down.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node of its component."""
    current, before, k = scratch.put(edges.select("u", "v").where("u <> v"), f"{name}0"), None, 0
    while True:
        mark = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before or not mark[0]:
            break
        if mark[0] <= WHOLE:
            ship(scratch.spark)
            roots = scratch.put(current.coalesce(1).mapInArrow(released(_whole), "node long, root long"), f"{name}-roots")
            scratch.drop(f"{name}{k}")
            return roots
        before, k = mark, k + 1
        current = scratch.put(_small_star(_large_star(current, lambda df, what, k=k: scratch.put(df, f"{name}-{what}{k}"))), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
