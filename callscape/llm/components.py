"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.llm.common import stored


def _least(both: DataFrame) -> DataFrame:
    """Each directed edge (u, v) with the least of u and all its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    m = stored(least.select("u", F.least("m", "u").alias("m")), "least")
    return both.join(m, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b) but the roots; a root is the least vertex of
    its component.

    A step keeps at most as many edges as there were, and the number of steps grows with the
    logarithm of the longest path. Every step is a stored table. The neighbours of a hot vertex
    are never gathered: their minimum is combined inside tasks, and the join back reads stored
    tables, so adaptive execution can split it.
    """
    now = stored(edges.where("a <> b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"),
                                                           F.col("u").alias("v")))
        large = stored(
            _least(both).where("v > u").select("v", F.col("m").alias("u"))
            .where("u <> v").distinct(), "large")
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        small = _least(down)
        then = stored(
            small.select("v", F.col("m").alias("w"))
            .unionByName(small.select(F.col("u").alias("v"), F.col("m").alias("w")))
            .where("v <> w").select("v", F.col("w").alias("u")).distinct(), "small")
        same = now.join(then, ["u", "v"], "left_anti").isEmpty()
        if same and then.join(now, ["u", "v"], "left_anti").isEmpty():
            return then.select("v", F.col("u").alias("root"))
        now = then
