"""Running totals over a table in one global order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage


def with_total_before(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before a row in ascending ``order``.

    Ranges of the order go to tasks of about equal size; only one total per range meets in one
    place.  ``order`` should be unique, else rows that tie get their totals in any order.
    """
    ranged = cut_lineage(
        df.withColumn("_value", value)
        .repartitionByRange(*order)
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = (
        ranged.groupBy("_range")
        .agg(F.sum("_value").alias("_total"))
        .select("_range", F.coalesce(F.sum("_total").over(across), zero).alias("_start"))
    )
    return (
        ranged.join(F.broadcast(starts), "_range")  # one small row per task
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(inside), zero))
        .drop("_range", "_start", "_value")
    )
