"""Running values along an order within groups of any size.

A window over a group is one task's work, so a group with a third of all rows
would be one task's third.  Here groups are cut into ranges of the (integer)
order; what crosses a range is combined per range on the map side, carried over
ranges by a window that has one row per range, and joined back.

Cases: rows with a null group form a group; a null order counts as the lowest;
rows of equal order count together in ``running`` and do not see each other in
``previous``; nulls in the value add nothing and are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 65_536
_LOWEST = -(2**63) + 1  # one above the lowest, so that "strictly before" cannot overflow


def _cut(rows: DataFrame, order: str, value: Column) -> DataFrame:
    place = F.greatest(F.col(order).cast("long"), F.lit(_LOWEST))
    return rows.withColumns({"_v": value, "_at": place, "_range": F.floor(F.coalesce(F.col(order), F.lit(0)) / RANGE)})


def _joined(cut: DataFrame, carried: DataFrame, group: str) -> DataFrame:
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r"))
    return cut.join(carried, same, "left").drop("_g", "_r")


def running(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` up to and with each row's order."""
    cut = _cut(rows, order, value.cast("long"))
    whole = cut.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.sum("_v").alias("_sum"))
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("_g", "_r", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_range").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("_inside", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return _joined(summed, carried, group).withColumn(name, F.col("_inside") + F.col("_before")).drop(
        "_v", "_at", "_range", "_inside", "_before"
    )


def previous(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the last value of a strictly lower order in the group; of equal
    orders the greatest value stands for all."""
    cut = _cut(rows, order, value)
    whole = cut.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(
        F.max(F.when(F.col("_v").isNotNull(), F.struct("_at", "_v"))).alias("_last")
    )
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("_g", "_r", F.last("_last", ignorenulls=True).over(earlier)["_v"].alias("_before"))
    inside = Window.partitionBy(group, "_range").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("_v").isNotNull(), F.struct("_at", "_v"))).over(inside)
    return _joined(cut.withColumn("_inside", seen["_v"]), carried, group).withColumn(
        name, F.coalesce("_inside", "_before")
    ).drop("_v", "_at", "_range", "_inside", "_before")
