"""Places of rows in the order of their group, without a window over a group.

Rows are sorted by ranges of (group, order), so a group of any size lies in neighbouring partitions.  A place is the row's place in
its partition plus the rows of its group in earlier partitions, and only that small table of counts meets a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumbre.llm.common import shared_table
from lumbre.session import broadcast_if_small

#: ``monotonically_increasing_id`` holds the partition above this many bits.
ROW_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``_index`` (from 0 within the group) and ``_count`` (rows of the group).  ``group`` has no nulls."""
    keys = [F.col(group), *order]
    placed = shared_table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", ROW_BITS))
    cuts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    shifts = cuts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_count"))
    return placed.join(broadcast_if_small(shifts), [group, "_part"]).withColumn("_index", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
