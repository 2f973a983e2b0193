"""Connected components: in numpy for one task's edges, and over a DataFrame of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import written


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over the edges a-b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == root).all():
            return root
        root = new


def forest(nodes_a: np.ndarray, nodes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) with the same components as the edges given."""
    ids, at = np.unique(np.concatenate([nodes_a, nodes_b]), return_inverse=True)
    a, b = at[: len(nodes_a)], at[len(nodes_a) :]
    root = labels(len(ids), a, b)
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node with an edge to another.

    ``edges`` has two long columns a and b; nulls, loops and repeats are ignored.  Large-star
    and small-star steps alternate (Kiveris et al., 2014): each is a minimum by key with map-side
    combining and a join that AQE can split, so that a hub does not land in one task, and the
    number of rounds follows the logarithm of the longest path.  Each round is written to the
    shared folder.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now = written(spark, edges.where(F.col("a") != F.col("b")).select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u != v")
        now = written(spark, small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
