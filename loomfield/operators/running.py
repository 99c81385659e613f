"""Running sums in order within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_table


def running_sums(df: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """df with cum_<s>, the sum of s up to and with the row, and all_<s>, the group's sum; (keys, order) must be distinct.

    Rows are cut into ranges of (keys, order) and stored, each range is summed
    by itself, and what the ranges before it hold of its group is added. A group
    over many ranges is summed in many tasks; what meets in one task are a
    group's ranges, of which there are no more than shuffle partitions.
    """
    laid = work_table(df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy(*keys, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums], *[F.sum(s).over(group).alias(f"all_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    own = laid.select("*", *[F.sum(s).over(inside).alias(f"_own_{s}") for s in sums])
    both = own.join(totals, [*keys, "_range"])
    return both.select(*df.columns, *[(F.col(f"_own_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums], *[f"all_{s}" for s in sums])
