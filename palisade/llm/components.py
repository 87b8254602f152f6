"""Connected components of a graph in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import few, save


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node and component (the least node in it) for every node that has a link (a, b).

    Rounds of large and small stars: every node tells its greater neighbours of the least one, then
    its lesser ones. Each round is written out; nothing is gathered, and a hub's neighbours are dealt
    out by the joins' skew handling. The rounds end when all links go to the least nodes, after about
    the logarithm of the longest chain.
    """
    links = save(spark, links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = links.count()
    while True:
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        ends = few(ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")), n)
        if ends.filter("ups > 1 OR (ups = 1 AND least = 0)").isEmpty():
            break
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(sides.groupBy("a").agg(F.min("b").alias("m")), n).select("a", F.least("a", "m").alias("m"))
        large = few(sides.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"), n).distinct()
        # in a large star's result every a is greater than its b
        least = few(large.groupBy("a").agg(F.min("b").alias("m")), n)
        small = few(large.join(least, "a"), n).select(F.col("b").alias("x"), "m", "a")
        small = small.select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("a").alias("x"), "m"))).alias("l")).select(F.col("l.x").alias("a"), F.col("l.m").alias("b")).filter("a <> b").distinct()
        links = save(spark, few(small, n), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
