"""Connected components of a graph whose edges are rows, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlake.llm.base import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour of a node that is larger than it moves to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.select(F.col("high").alias("node"), F.col("low").alias("other"))
    least = materialize(both.groupBy("node").agg(F.min("other").alias("least")), "least")
    return (
        both.join(least, "node")
        .filter("other > node")
        .select(F.col("other").alias("high"), F.least("least", "node").alias("low"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = materialize(edges.groupBy("high").agg(F.min("low").alias("least")), "least")
    moved = (
        edges.join(least, "high")
        .select(F.col("low").alias("high"), F.col("least").alias("low"))
        .filter("high <> low")
    )
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach, other than itself.

    A root has no row. Rounds grow with the logarithm of the longest path. Each round
    is written to the shared folder, so lineage stays short. Groupings only take minima, which
    tasks combine before the shuffle. Minima are stored before they are joined: a join deals both
    sides out anew, and the edges of a node that has many can be split over tasks.
    """
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    now = materialize(edges.select(low, high).filter("low < high").distinct(), "edges")
    state = None
    while True:
        row = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(high, low))")).first()
        if tuple(row) == state or not row[0]:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root"))
        state = tuple(row)
        now = materialize(_small_star(_large_star(now)), "edges")
