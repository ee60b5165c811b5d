"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of `links` (a, b) but the roots themselves; root: the smallest node reachable.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest. Rounds
    grow with the logarithm of the size; the number of links never grows. Minima are partial sums, so
    a node with very many links is no single task; the driver sees two numbers a round.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x != y").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges = stored(small.union(least.select("x", F.col("m").alias("y"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
