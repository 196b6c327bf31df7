"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.session import landed


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in ``links`` (columns ``a`` and ``b``).

    Every round makes stars twice.  First each node hands its larger neighbours to its smallest one, then it
    hands its smaller neighbours, and itself, to the smallest of them.  No round makes more links than
    there were, a path's length halves, and at the end each component is one star around its smallest node: on
    paths of any order that takes about log2 of their length.  Smallest neighbours are partial
    aggregates, so a node with very many links is summed up before it is shuffled and split by the adaptive
    planner in joins.  Rounds are landed; only a count returns to the driver.  Links of a node to itself
    and links with a missing end are left out.
    """
    lower, higher = F.least("a", "b"), F.greatest("a", "b")
    stars = landed(
        links.filter("a <> b").select(higher.alias("node"), lower.alias("other")).distinct(), "links"
    )
    while True:
        back = stars.select(F.col("other").alias("node"), F.col("node").alias("other"))
        both = stars.unionByName(back)
        nearest = both.groupBy("node").agg(F.least(F.min("other"), "node").alias("least"))
        large = (
            both.filter("other > node")
            .join(nearest, "node")
            .select(F.col("other").alias("node"), F.col("least").alias("other"))
            .distinct()
        )
        large = landed(large, "large-stars")
        nearest = large.groupBy("node").agg(F.min("other").alias("least"))
        small = (
            large.join(nearest, "node")
            .filter("other <> least")
            .select(F.col("other").alias("node"), F.col("least").alias("other"))
            .unionByName(nearest.select("node", F.col("least").alias("other")))
            .distinct()
        )
        stars = landed(small, "small-stars")
        # done once no node has two links and no centre has a link to a smaller node
        again = stars.groupBy("node").count().filter("count > 1").select("node")
        centres = stars.select(F.col("other").alias("node"))
        if again.unionByName(stars.select("node").join(centres, "node", "left_semi")).isEmpty():
            break
    found = stars.select("node", F.col("other").alias("component"))
    return found.unionByName(stars.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct())
