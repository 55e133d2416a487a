"""Running sums over groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch


def running_sum(
    scratch: Scratch, df: DataFrame, name: str, group: list[str], order: list[str], value: str
) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over earlier rows of the group.

    Rows are dealt by range of group and order, so that a group of any size spreads over many
    tasks. A range is summed on its own, and shifted by what the ranges before it hold of the
    group. ``value`` is never null; columns of ``group`` may be.
    """
    dealt = df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    dealt, _ = scratch.keep(dealt, name)
    totals = dealt.groupBy(*group, "_range").agg(F.sum(value).alias("_total"))
    ranges = Window.partitionBy(*group).orderBy("_range")
    shift = F.sum("_total").over(ranges) - F.col("_total")
    starts = totals.select(
        *[F.col(c).alias(f"_{c}") for c in group], F.col("_range").alias("_part"), shift.alias("_start")
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("_inside", F.sum(value).over(inside) - F.col(value))
    alike: list[Column] = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    met = reduce(lambda a, b: a & b, alike, F.col("_range") == F.col("_part"))
    return (
        summed.join(starts, met)
        .withColumn("before", F.col("_start") + F.col("_inside"))
        .select(*df.columns, "before")
    )
