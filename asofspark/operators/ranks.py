"""Counts in a global order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import scratch


def with_counts_before(df: DataFrame, order: list[str], weight: Column) -> DataFrame:
    """df with `before`, the sum of weight over all rows that come earlier in the order, and `total`, that over all.

    Rows are range-partitioned by the order and written, so that every pass sees the same partitions; each is summed on
    its own, and the sums of those before it, of which there are as many as partitions, are added. Rows that are equal
    in the order are numbered in any way among themselves."""
    path = scratch(df.sparkSession)
    df.withColumn("_w", weight.cast("long")).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    parts = rows.groupBy("_p").agg(F.sum("_w").alias("_s"))  # one row per partition
    starts = parts.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_start"), F.sum("_s").over(Window.partitionBy()).alias("total"))
    here = F.sum("_w").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    found = rows.withColumn("_here", here).join(starts, "_p")
    return found.withColumn("before", F.col("_start") + F.col("_here")).drop("_p", "_w", "_start", "_here")
