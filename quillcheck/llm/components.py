"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node that has a link: node and root, the smallest node it reaches.

    Nodes are longs. Every step replaces links by links to the smallest neighbour; the number of steps grows with the
    logarithm of the longest chain. Each step's links are stored, and only their count and hash sum come to the driver.
    """
    links = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo")
    links, last = cut(links.distinct()), None
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        both = both.union(both.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = cut(small.union(least.select("hi", "m")).distinct())
        sign = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if sign == last:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        last = sign
