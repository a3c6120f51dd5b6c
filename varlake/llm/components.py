"""Connected components of an edge table by alternating large and small stars.

Edges stay distributed; each round is two aggregations with partial sums and two joins that
adaptive execution can split, and is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlake.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (or not larger) neighbours to the least node around it."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    else:
        both = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
    tied = both.join(least, "v")
    if large:
        return tied.where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
    out = tied.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b"))
    own = least.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.unionAll(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: comparable, not null); root is the least.

    Self-edges and repeats are harmless. Nodes without an edge are not listed; no edge gives no
    row.
    """
    edges = cut_lineage(edges.where("a != b").select("a", "b").distinct())
    before, rows = None, edges.count()
    while True:  # a star has no more edges than what it is made of
        edges = cut_lineage(_star(_star(edges, True), False).where("a != b"), rows)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before, rows = mark, mark[0]
    root = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return root.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
