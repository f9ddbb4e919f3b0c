"""Connected components of a link table, by alternating large and small stars.

Every round joins links with the smallest neighbour of each node, which is
aggregated before the shuffle; nothing is collected, and each round is a table
in the shared folder, so neither lineage nor a lost executor starts it over.
The rounds needed grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.store import written


def _downward(links: DataFrame, purpose: str) -> DataFrame:
    """Different links between different nodes, from the larger to the smaller."""
    return written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), purpose)


def _state(links: DataFrame) -> tuple:
    """Equal for equal link tables."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``): the smallest node it can reach.

    Links with a null end, repeated links and links of a node with itself are
    allowed and count for nothing. Without links the result has no rows.
    """
    links = _downward(links, "links")
    before, after = None, _state(links)
    while after != before and after[0]:
        # Large star: larger neighbours move to the smallest one.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = written(
            links.select(F.col("b").alias("a"), F.col("a").alias("above")).join(least, "a").select(F.col("above").alias("a"), F.col("low").alias("b"))
            .distinct(), "large-star")
        # Small star: a node and its smaller neighbours move to the smallest one.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = _downward(small.union(least.select("a", F.col("low").alias("b"))), "small-star")
        before, after = after, _state(links)
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
