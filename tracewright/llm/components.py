"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step points the neighbours of a node at the smallest one they know of; the stars halve the remaining paths, so the number of rounds
grows with the logarithm of the longest chain. All state is a table of links; groupings combine before their shuffle and each join has a
unique side, so a node with very many links is spread by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import settle


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    around = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
    least = around.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("lo"), F.least("u", "v").alias("m"))
    return e.join(least, "lo").select("hi", F.col("m").alias("lo"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` that is not itself the smallest of its component.

    Nodes are values of one orderable type. Links of a node with itself and repeated links do no harm; links with a null end are ignored.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    e = settle(pairs.where("hi is not null and lo is not null").distinct())
    before = _sign(e)
    while before[0]:
        e = settle(_small_star(_large_star(e)).distinct())
        after = _sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
