"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm.common import shared_table


def _stars(links: DataFrame) -> DataFrame:
    """One large and one small star step over distinct links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    hung = large.join(down, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(down.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link in (a, b); the component is its smallest node.

    Each round is written to the shared folder; only a count and a checksum of the links come to the driver.
    """
    now = shared_table(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).alias("mark")
    before = now.agg(mark).first()["mark"]
    while before[0]:
        now = shared_table(_stars(now))
        after = now.agg(mark).first()["mark"]
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
