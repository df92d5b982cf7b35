"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is one aggregation and one join on the node. Minima are combined before they are shuffled, and the joins read
written tables on both sides, so adaptive execution can split a node that has very many links. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node without one."""
    nodes, ends = edges.select("u"), edges.select(F.col("v").alias("u")).distinct()
    return nodes.join(ends, "u", "left_semi").isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with a link to another one; the root is the least node of its component.

    Links with a null end and links of a node with itself are no links. Without links the result is empty.
    """
    a, b = F.col(left), F.col(right)
    edges = materialize(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = materialize(both.join(least, "u").filter(F.col("v") > F.col("u"))
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
