"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, label: for edges (a, b), every node that has an edge and the smallest node that it can reach.

    The number of rounds grows with the logarithm of a component's length. Each round aggregates and
    joins on a node, which Spark splits for a node with very many edges; nothing goes to the driver
    but one count, of nodes that are not yet tied straight and only to a root.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    while True:
        tied = e.groupBy("u").agg(F.count("*").alias("n"))
        loose = tied.where("n > 1").select("u").unionByName(e.select(F.col("v").alias("u")).join(tied, "u", "left_semi"))
        if loose.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = written(low, "components-low")  # so that Spark can split the join for a node with very many edges
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        e = written(small, "components")
