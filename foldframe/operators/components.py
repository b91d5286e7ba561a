"""Connected components of an edge table, without ever bringing edges or groups together in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the least node that links reach.

    Alternates large-star and small-star steps (each keeps the components) until every node but the least of a component
    hangs on that one alone; the number of steps grows with the logarithm of the longest path.  A hub only takes part in
    aggregates with partial sums and in joins that Spark can split.  Nodes without a link to another node are not in
    the result.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))))
        if not open_nodes.first()[0]:  # all edges lead to roots, one from each node
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        e = checkpointed(small)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
