"""Running sums over a whole table in the order of a column, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def running(df: DataFrame, by: list[str], order: str, column: str, name: str, descending: bool = False) -> DataFrame:
    """Adds ``name``: the sum of ``column`` up to and with each row, in the order of ``order``, whose values are distinct.

    With ``by``, a window per group. Without, rows are dealt over ranges of the order and written; each range is summed
    (a row per range, whose running sum is broadcast), and windows run inside the ranges.
    """
    sort = F.desc(order) if descending else F.asc(order)
    if by:
        return df.withColumn(name, F.sum(column).over(Window.partitionBy(*by).orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)))
    ranges = stored(df.repartitionByRange(sort).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("_range").agg(F.sum(column).alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    inside = F.sum(column).over(Window.partitionBy("_range").orderBy(sort).rowsBetween(Window.unboundedPreceding, 0))
    out = ranges.withColumn("_inside", inside).join(F.broadcast(before), "_range")
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")
