"""Trees of pseudojets and showers: descendants, walking, simplifying, merging, borders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinematics as K


def leaf_sets(trees: DataFrame, keep, limit: int = 1000) -> DataFrame:
    """(event_id, pj_idx, leaf) of every pseudojet, itself for an input; parents are followed upwards.

    `keep` stores each level; the walk ends at the roots.
    """
    up = keep(trees.select("event_id", "pj_idx", "parent", "input_idx"))
    front = up.where("input_idx >= 0").select("event_id", F.col("pj_idx").alias("leaf"), "pj_idx", "parent")
    levels = []
    for _ in range(limit):
        levels.append(front.select("event_id", "pj_idx", "leaf"))
        above = front.where("parent >= 0").select("event_id", "leaf", F.col("parent").alias("pj_idx"))
        front = keep(above.join(up.select("event_id", "pj_idx", "parent"), ["event_id", "pj_idx"]).select("event_id", "leaf", "pj_idx", "parent"))
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def joins_walked(trees: DataFrame) -> DataFrame:
    """(event_id, pj_idx, left, right, d_rapidity, d_phi, d_pt, wraps): children by pt, the harder one left."""
    t = trees.select("event_id", F.col("pj_idx").alias("c"), "pt", "rapidity", "phi")
    one = trees.where("child1 >= 0").select("event_id", "pj_idx", F.explode(F.array("child1", "child2")).alias("c")).join(t, ["event_id", "c"])
    w = Window.partitionBy("event_id", "pj_idx").orderBy(F.desc("pt"), "c")
    placed = one.withColumn("r", F.row_number().over(w))
    take = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    both = placed.groupBy("event_id", "pj_idx").agg(take(1, "c").alias("left"), take(2, "c").alias("right"), *(take(r, c).alias(f"{c}{r}") for r in (1, 2) for c in ("pt", "rapidity", "phi")))
    return both.select(
        "event_id", "pj_idx", "left", "right", (F.col("rapidity1") - F.col("rapidity2")).alias("d_rapidity"), K.angular_distance(F.col("phi1"), F.col("phi2")).alias("d_phi"), (F.col("pt1") - F.col("pt2")).alias("d_pt"), (F.abs(F.col("phi1") - F.col("phi2")) > K.PI).alias("wraps")
    )


def simplify(edges: DataFrame, steps: int, keys: list[str]) -> DataFrame:
    """(keys, parent, child) after chains of nodes with one parent and one child are cut short; pointer doubling."""
    outs = edges.groupBy(*keys, "parent").agg(F.count("*").alias("n_out"), F.min("child").alias("only_child"))
    ins = edges.groupBy(*keys, "child").agg(F.count("*").alias("n_in"))
    inner = outs.where("n_out = 1").join(ins.where("n_in = 1").select(*keys, F.col("child").alias("parent")), [*keys, "parent"], "left_semi")
    jump = inner.select(*keys, F.col("parent").alias("node"), F.col("only_child").alias("to"))
    for _ in range(steps):
        further = jump.select(*keys, F.col("node").alias("to"), F.col("to").alias("after"))
        jump = jump.join(further, [*keys, "to"], "left").select(*keys, "node", F.coalesce("after", "to").alias("to"))
    kept = edges.join(inner.select(*keys, "parent"), [*keys, "parent"], "left_anti")
    return kept.join(jump.withColumnRenamed("node", "child"), [*keys, "child"], "left").select(*keys, "parent", F.coalesce("to", "child").alias("child")).distinct()


def amalgamate(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two showers; rows of equal keys must agree, else an error."""
    rest = [c for c in a.columns if c not in keys]
    both = a.unionByName(b).groupBy(*keys).agg(*(F.first(c).alias(c) for c in rest), F.size(F.collect_set(F.struct(*rest))).alias("__n"))
    return both.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("two showers disagree about a particle")).cast("boolean"))).drop("__n")


def outside_connections(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with a parent that is not in the set."""
    mine = edges.join(nodes.select(*keys, F.col("node").alias("child")), [*keys, "child"], "left_semi")
    out = mine.join(nodes.select(*keys, F.col("node").alias("parent")), [*keys, "parent"], "left_anti")
    return out.select(*keys, F.col("child").alias("node")).distinct()
