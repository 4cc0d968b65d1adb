"""Connected components of an edge table, by alternating large and small stars.

No neighbourhood is gathered: a node's least neighbour is an aggregate that is
joined back, so a hub is split like any other skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), longs; root is the least node of its component.

    Loops, repeats and nulls are ignored; without edges there are no rows. The
    rounds grow with the logarithm of the longest path; each ends in a checkpoint.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = cut(edges.filter("a is not null and b is not null and a <> b").select(a, b).distinct())
    state = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == tuple(new) or not new[0]:
            break
        state = tuple(new)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low)
        now = cut(small.select("a", "b").distinct())
    stars = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return stars.union(now.select("b", "b").distinct())
