"""Combining, splitting and comparing sets of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(fragments: list[DataFrame], key: str = "event_id", drop_duplicates: bool = False) -> DataFrame:
    """Rows of all fragments, by column name; duplicates of the key go if asked for."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fragments)
    return out.dropDuplicates([key]) if drop_duplicates else out


def weighted_settings(settings: DataFrame) -> DataFrame:
    """Hyperparameters of recombined fragments: averages weighted by fragment length."""
    return settings.groupBy("param").agg((F.sum(F.col("value") * F.col("length")) / F.sum("length")).alias("value"))


def split_by_bounds(rows: DataFrame, key: str, bounds: list[int]) -> DataFrame:
    """Part number by lower bounds: part k holds keys from bounds[k-1] up to bounds[k]."""
    part = F.lit(0)
    for b in bounds:
        part = part + F.when(F.col(key) >= b, 1).otherwise(0)
    return rows.withColumn("part", part)


def split_evenly(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Part number by a hash of the key."""
    return rows.withColumn("part", F.pmod(F.col(key), F.lit(n)))


def split_unfinished(rows: DataFrame, done: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose key is done, and those still to do."""
    ids = done.select(key).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def shared(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def missing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def common_columns(*frames: DataFrame) -> list[str]:
    """Column names that all have, in the order of the first."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]


def folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Cross-validation fold of each row."""
    return rows.withColumn("fold", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(k)).cast("int"))
