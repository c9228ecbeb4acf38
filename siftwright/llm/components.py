"""Connected classes of linked items: forests inside tasks, star contraction between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import pin, unpin


class Forest:
    """Links of the items 0..n-1 seen in one task, reduced to a spanning forest as they arrive.

    A group of g items that are all linked gives g - 1 edges, not g * g / 2.
    """

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.label[a], self.label[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                return
            high, at = np.unique(np.maximum(ra, rb), return_index=True)
            self.edges.append((a[at], b[at]))
            self.label[high] = np.minimum(ra, rb)[at]
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up

    def spanning(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([e[0] for e in self.edges]), np.concatenate([e[1] for e in self.edges])


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.col("hi") % 1000003), F.sum(F.xxhash64("hi", "lo") % 1000003)).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node reachable.

    Large and small stars in turn; every round is written, so a lost executor repeats one round only.
    Minima are combined before the shuffle. No node's neighbours are ever gathered, so a hub with a
    third of all links is spread like any other key of an adaptive join. Empty links give no rows.
    """
    edges = pin(links.select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    ).filter("hi <> lo").distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = pin(large)
        low = down.groupBy("hi").agg(F.min("lo").alias("m"))
        small = down.join(low, "hi").select(
            F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")
        ).distinct()
        after = pin(small)
        now = _signature(after)
        unpin(edges)
        unpin(down)
        edges = after
        if now == before:
            break
        before = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
