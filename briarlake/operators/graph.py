"""Connected components over links between 64-bit node ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.scratch import Scratch


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indices over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _with_least(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u, or u itself if less.

    The least neighbours are a written table of their own: then both sides of
    the join are plain exchanges, and AQE can split the partition of a hub.
    """
    least = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    return edges.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that has a link: root is the smallest node id reachable.

    `edges` has long columns a and b. Alternates large-star and small-star steps
    (Kiveris et al., Connected Components in MapReduce and Beyond, 2014) until
    the edges are stars around the smallest nodes. Only counts and a checksum
    reach the driver; every round is written, so lost executors cost one round.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        count, *rest = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if count == 0 or (count, *rest) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (count, *rest)
        both = scratch.keep(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = scratch.keep(_with_least(both, scratch).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        met = _with_least(large, scratch)
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        after = scratch.keep(met.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        for gone in (now, both, large):
            scratch.drop(gone)
        now = after
