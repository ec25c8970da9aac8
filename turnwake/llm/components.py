"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregate and a join on the node, so a hub with any number of neighbours is
pre-aggregated before the shuffle and split by the skew join after it. The edges are written
after each pair of steps, in as many tasks as they fill; nothing is collected but two
counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, cut_small


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    near = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").coalesce(tasks).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of its component, for every node that is not that itself."""
    now, mark = cut_small(edges.select("a", "b").filter("a <> b")), None
    tasks = max(1, now.count() // SMALL)
    while True:
        now = cut_small(_small(_large(now.coalesce(tasks)).coalesce(tasks), tasks).coalesce(tasks))
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == mark or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        mark = seen
