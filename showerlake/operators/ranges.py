"""Running sums over sorted groups of any size: ranges of the order are summed apart and offset by what lies before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keeper


def running_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """`rows` with, under each name of `sums`, its column summed over the group up to and including the row, in this order.

    The table is dealt out by ranges of (by, order), stored once, and each range of a group is a window of its
    own; a group's offsets are one row per range, so a group may hold all rows. The order should have no ties.
    """
    ranged = keeper(rows.sparkSession)(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__range", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, [*by, "__range"])
    return joined.select(*rows.columns, *((F.sum(c).over(inside) + F.col(f"__{n}")).alias(n) for n, c in sums.items()))
