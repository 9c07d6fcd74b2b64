"""Connected components by alternating large and small stars, all in Spark.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014. Links never
reach the driver; each round is written to the shared folder, so a lost executor
repeats at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tochi.llm.common import BROADCAST_FACTS, discard, saved, with_facts


def _with_least(links: DataFrame, n: int) -> tuple[DataFrame, list[DataFrame]]:
    """``links``, at most ``n``, with m, the least of u's neighbours and u; and saved tables it reads."""
    least = links.groupBy("u").agg(F.min("v").alias("x"), F.count("*").alias("degree")).select("u", F.least("u", "x").alias("m"), "degree")
    if n <= BROADCAST_FACTS:
        return links.join(F.broadcast(least.drop("degree")), "u"), []
    facts = saved(least, "cc")
    return with_facts(links, facts, "u", "degree").drop("degree"), [facts]


def _are_stars(edges: DataFrame) -> bool:
    """No node has two centres, and no centre is a member of another star."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("member"), F.lit(0).alias("centre")), F.struct(F.col("v").alias("node"), F.lit(0).alias("member"), F.lit(1).alias("centre")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("member").alias("m"), F.max("centre").alias("c")).filter("m > 1 or m = 1 and c = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b); component is the least node.

    Loops and repeated links are allowed; null ends are not links. No links, no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = saved(edges.filter("u > v").distinct(), "cc")
    n = edges.count()
    while not _are_stars(edges):
        # large star: neighbours above a node go to the least around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, read = _with_least(both, 2 * n)
        large = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.filter("u > v").distinct(), "cc")
        discard(edges, *read)
        # small star: a node and its lesser neighbours go to the least of them
        joined, read = _with_least(large, 2 * n)
        small = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = saved(small.filter("u > v").distinct(), "cc")
        discard(large, *read)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
