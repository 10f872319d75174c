"""Connected components of an edge table, by alternating large and small
stars; every round is written to the shared folder, and only a count and a
checksum of the edges come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least of its own."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select(
        "n", F.least("n", "m").alias("m"))
    return (both.where("b > a").join(least, F.col("a") == F.col("n")).where("b > m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    tied = down.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node with an edge, ``component`` being the
    smallest node that it reaches.  ``edges`` has columns a and b; loops and
    rows with a null are ignored."""
    current = stored(edges.select("a", "b").where("a <> b").distinct(), name)
    before = None
    while True:
        state = current.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        current = stored(_small_star(_large_star(current)), name)
    # now every edge leads from a node to its component
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
