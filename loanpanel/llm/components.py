"""Connected components by alternating stars (Kiveris et al., Connected Components in MapReduce and Beyond)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.llm.storage import cut


ROWS_PER_TASK = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the smallest id reachable.

    Each round links every node to the smallest of its neighbourhood, first its larger
    neighbours, then its smaller ones, until all edges point at a smallest node. The number of
    rounds grows with the logarithm of the longest path. Edges and labels stay in tables, dealt to
    tasks by their number; minimums are partially aggregated, so a node with very many edges is no
    hot group. Edges with a null end are left out.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = max(8, -(-now.count() // ROWS_PER_TASK))  # a round makes no more edges than there are

    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(tasks)

    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = few(both.filter("v > u").join(low, "u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (few(large.join(low, "u")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.withColumnRenamed("m", "v")))
        now = cut(few(small.distinct()))
        # stars: no node has two edges, none is pointed at and points on
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            now.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        seen = few(ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")))
        if seen.filter("out > 1 or (out = 1 and into = 1)").isEmpty():
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
