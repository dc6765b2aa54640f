"""Connected components of a link table, by alternating large and small stars.

Every round is two aggregations and joins of narrow rows. A node with very many links is aggregated
before the shuffle and never gathered in one place; rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.stored import settle


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's least neighbour."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the least of these."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", "m")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the least node that each linked node reaches. Loops and nulls link nothing.

    Nodes are 64-bit integers. The least node of a component is a row too.
    """
    made = settle(
        links.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"), F.col(a), F.col(b))
        .where(f"`{a}` <> `{b}`").select("hi", "lo").distinct())
    while True:
        made = settle(_small(_large(made)))
        state = made.groupBy("hi").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (state or 1) == 1 and made.join(made.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty():
            break
    return made.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        made.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
