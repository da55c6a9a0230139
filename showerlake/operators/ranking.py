"""Order, windows over masses, gaps, most common values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_sums


def ordered(jets: DataFrame, variable: str) -> DataFrame:
    """Place of each jet in ascending order of a variable within its event."""
    return jets.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(variable, "idx")) - 1)


def quality_width(masses: DataFrame, group: str, fraction: float) -> DataFrame:
    """Narrowest window of masses that holds the fraction of a group's events, per event; null under two masses.

    The group's sizes are counted before the window, so each mass looks ahead by a fixed number of places.
    """
    n = masses.groupBy(group).agg(F.count("*").alias("n"))
    placed = running_sums(masses.select(group, "mass", "event_id", F.lit(1).alias("one")), [group], ["mass", "event_id"], {"r": "one"}).select(group, "mass", "r")
    want = n.select(group, "n", F.greatest(F.lit(2), F.least(F.ceil(F.col("n") * fraction), F.col("n"))).cast("int").alias("target"))
    low = placed.join(want, group)
    high = placed.select(group, F.col("r").alias("hr"), F.col("mass").alias("hm"))
    pairs = low.join(high, (low[group] == high[group]) & (F.col("hr") == F.col("r") + F.col("target") - 1)).select(low[group], "n", "target", (F.col("hm") - F.col("mass")).alias("width"))
    best = pairs.groupBy(group).agg((F.min("width") / F.first("n")).alias("width_per_event"))
    return n.select(group).join(best, group, "left")


def quality_fraction(masses: DataFrame, group: str, mass: float, multiplier: float) -> DataFrame:
    """Events per event in the fullest half-open window [m, m + multiplier * mass) that starts at a mass."""
    width = float(multiplier * mass)
    values = masses.groupBy(group, "mass").agg(F.count("*").alias("n"))
    # a window's ends are marks between the masses, which sort before a mass of the same value
    marks = values.select(group, "mass", F.explode(F.array(F.struct(F.col("mass").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("mass") + width).alias("at"), F.lit(1).alias("sign")))).alias("e"))
    rows = values.select(group, F.col("mass").alias("at"), F.lit(2).alias("kind"), "mass", "n").union(marks.select(group, "e.at", "e.sign", "mass", F.lit(0)))
    upto = running_sums(rows, [group], ["at", "kind", "mass"], {"upto": "n"}).where("kind < 2")
    inside = upto.groupBy(group, "mass").agg(F.sum(F.col("kind") * F.col("upto")).alias("inside"))
    return masses.groupBy(group).agg(F.count("*").alias("n")).join(inside.groupBy(group).agg(F.max("inside").alias("most")), group).select(group, (F.col("n") / F.col("most")).alias("events_per_window"))


def quality_width_fraction(masses: DataFrame, group: str, mass: float, fraction: float, multiplier: float) -> DataFrame:
    """Both qualities of a group; the number of masses wanted is kept between two and all, and nothing is an error."""
    return quality_width(masses, group, fraction).join(quality_fraction(masses, group, mass, multiplier), group, "left")


def gap_groups(rows: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Group number per key: a new one starts where sorted values are further apart than the gap."""
    w = Window.partitionBy(*keys).orderBy(value, "idx")
    jump = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("__jump", jump).withColumn("gap_group", F.sum("__jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__jump")


def most_common(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values (ties: smallest value)."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
