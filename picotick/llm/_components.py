"""Connected components of a link table, by alternating large and small stars.

Each round points every node at the least of its neighbours, once from the larger end of its
links and once from the smaller, and is written to the shared folder, so lineage stays short.
A few rounds suffice (the number grows with the logarithm of the longest chain). Minima are
aggregated before the shuffle. The joins that bring a minimum back to all links of its node are
plain sort-merge joins, which stream: where one node has very many links, Spark's adaptive skew
join splits them over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored


def components(links: DataFrame) -> DataFrame:
    """``a``, ``b`` (long) -> ``node``, ``root``: the least node that each linked node reaches."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lower, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lower.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


class Groups:
    """Union-find over 0..n-1, inside one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """True if i and j were in different groups."""
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j
