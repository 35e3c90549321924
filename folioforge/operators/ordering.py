"""Running sums and numbers over whole tables and hot groups without one task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.runtime import cut


def running(frame: DataFrame, by: list[str], order: list[str | Column], value: Column | int, name: str) -> DataFrame:
    """Add the running sum of ``value`` within each group, in an order that must be total.

    Rows are range-partitioned by group and order, so a hot group spreads over many tasks. Each part is summed up by itself;
    the parts' totals, one row for each group and part, give what comes before.
    """
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    parted = cut(frame.withColumn("_value", F.lit(value) if isinstance(value, int) else value).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy(*by, "_part").orderBy(*keys[len(by) :]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy(*by, "_part").agg(F.sum("_value").alias("_sum"))
    before = totals.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_part").alias("_own"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_own")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    summed = parted.withColumn("_local", F.sum("_value").over(local)).join(before, same)
    return summed.withColumn(name, F.col("_local") + F.col("_before")).select(*frame.columns, name)


def numbered(frame: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """Add a running number from 0, over the whole table or within each group."""
    return running(frame, by or [], order, 1, name).withColumn(name, F.col(name) - 1)
