"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultatlas.plans.layout import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links`` (columns ``a``, ``b``).

    ``component`` is the smallest node that links lead to.  Each round hangs the
    larger neighbours of every node, then the smaller ones, below the smallest
    neighbour, until every tree is a star; a round is a few aggregations by node with
    partial sums, so a hub is never gathered in one place.  Nulls and self links are
    left out; an empty table gives no row.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    stars = links.where(F.col("a") != F.col("b")).select(high.alias("node"), low.alias("to")).distinct()
    while True:
        stars = cut(_small(_large(stars)))
        # Done when every node hangs below one node, and that one below none.
        hung = stars.groupBy("node").agg(F.count("*").alias("n"))
        above = stars.select(F.col("to").alias("node")).distinct().withColumn("above", F.lit(1))
        if not hung.join(above, "node", "left").where("n > 1 OR above = 1").limit(1).count():
            break
    tops = stars.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct()
    return stars.withColumnRenamed("to", "component").unionByName(tops)


def _large(stars: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the node's smallest neighbour."""
    both = stars.unionByName(stars.select(F.col("to").alias("node"), F.col("node").alias("to")))
    least = both.groupBy("node").agg(F.min("to").alias("least")).select("node", F.least("node", "least").alias("least"))
    larger = both.where(F.col("to") > F.col("node")).join(least, "node")
    return larger.select(F.col("to").alias("node"), F.col("least").alias("to")).distinct()


def _small(stars: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them."""
    least = stars.groupBy("node").agg(F.min("to").alias("least"))
    hung = stars.join(least, "node").where(F.col("to") != F.col("least"))
    moved = hung.select(F.col("to").alias("node"), F.col("least").alias("to"))
    return moved.unionByName(least.withColumnRenamed("least", "to")).distinct()
