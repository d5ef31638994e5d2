"""Row numbers in groups that no task should hold, by ranges of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.sources.staging import staged


def in_ranges(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df with name: 1 and more, the place of a row in its group by an order. For groups of many rows, of which there are few.

    Rows are dealt by ranges of group and order; a task numbers its share of a group, and how many rows of the group lie in
    the ranges before is a row for each group and range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(parts, F.col(group), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n")).select(group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(starts), [group, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")
