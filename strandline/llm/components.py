"""Connected components: local forests, then large-star and small-star steps on DataFrames.

Edges are dealt to as many tasks as their counted number needs (LOCAL edges each);
each task keeps a forest of its own edges.  One task's forest is the result; forests
of several go through star steps, which are aggregations and joins over edges.  No
neighbourhood is gathered in one place and nothing but sums reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, release, settle

#: Edges that one task reduces to a forest: two integers each, 16 MB.
LOCAL = 1_000_000


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if np.array_equal(low, high):
            return nodes, nodes[parent]
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _forest(batches):
    """A task's edges as node and root; roots themselves are left out."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        node, root = roots_of(u, v)
        kept = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(root[kept])], ["u", "v"])


def _large(e: DataFrame) -> DataFrame:
    """Distinct edges u > v: every node's larger neighbours go to its smallest one."""
    both = e.union(e.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Edges u > v: every node's smaller neighbours go to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).union(moved).distinct()


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """Columns node and root (the smallest node reachable) from edges u, v of integers.

    Loops and repeated edges may come; nodes without an edge to another are left out.
    """
    first = settle(edges.where("u <> v and u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), narrow=True)
    parts = -(-first.count() // local)
    e = settle(first.repartition(max(1, parts)).mapInArrow(lean(_forest), "u long, v long"), narrow=True)
    release(first)
    before = None
    while parts > 1:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        old, e = e, settle(_small(_large(e)), narrow=True)
        release(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
