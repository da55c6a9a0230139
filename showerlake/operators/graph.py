"""Walks of parent-child graphs, level by level with joins; each level is a set, so shared subtrees are walked once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["event_id"]


def _level(front: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    return front.join(edges.withColumnRenamed("parent", "node"), [*keys, "node"]).select(*keys, "start", F.col("child").alias("node")).distinct()


def walk(starts: DataFrame, edges: DataFrame, keys: list[str], keep, limit: int = 1000) -> DataFrame:
    """(keys, start, node, depth) by every depth at which a node is reached, to the end of the graph.

    `keep` stores each level, so none is computed twice; a graph that still grows after `limit` levels (a
    cycle) is an error.
    """
    edges = keep(edges)
    front = keep(starts.select(*keys, "start", F.col("start").alias("node")).distinct())
    out = front.withColumn("depth", F.lit(0))
    for d in range(1, limit + 1):
        front = keep(_level(front, edges, keys))
        if front.isEmpty():
            return out
        out = out.union(front.withColumn("depth", F.lit(d)))
    raise RuntimeError(f"more than {limit} levels")


def descendants(starts: DataFrame, edges: DataFrame, depth: int, keys: list[str] = KEYS) -> DataFrame:
    """(keys, start, node, depth) of all nodes reachable in at most `depth` steps, starts included.

    The plan is unrolled and repeats shallow levels for deeper ones, so this is for a few levels; for a deep
    graph or an unknown depth use descendants_until_done.
    """
    front = starts.select(*keys, "start", F.col("start").alias("node")).distinct()
    out = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = _level(front, edges, keys)
        out = out.union(front.withColumn("depth", F.lit(d)))
    return out


def descendants_until_done(starts: DataFrame, edges: DataFrame, keys: list[str], keep, limit: int = 100) -> DataFrame:
    """The same without a known depth: `keep` stores each level's new nodes (cutting lineage), the walk ends when none is new."""
    front = keep(starts.select(*keys, "start", F.col("start").alias("node")).distinct())
    seen = front
    for _ in range(limit):
        new = keep(_level(front, edges, keys).join(seen, [*keys, "start", "node"], "left_anti"))
        if new.isEmpty():
            return seen
        seen, front = keep(seen.union(new)), new
    raise RuntimeError(f"more than {limit} levels")


def leaves(reached: DataFrame, edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Reached nodes without children; a start without children is its own leaf."""
    return reached.join(edges.select(*keys, F.col("parent").alias("node")).distinct(), [*keys, "node"], "left_anti").select(*keys, "start", "node").distinct()


def roots(nodes: DataFrame, edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Nodes with no parent inside the set."""
    inside = edges.join(nodes.select(*keys, F.col("node").alias("parent")), [*keys, "parent"], "left_semi")
    return nodes.join(inside.select(*keys, F.col("child").alias("node")).distinct(), [*keys, "node"], "left_anti")


def ranks(reached: DataFrame, edges: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, node, rank): longest path from any start; end nodes get the largest rank of their key group."""
    longest = reached.groupBy(*keys, "node").agg(F.max("depth").alias("depth"))
    most = longest.groupBy(*keys).agg(F.max("depth").alias("most"))  # without keys a single row, which may be broadcast
    inner = edges.select(*keys, F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    joined = longest.join(inner, [*keys, "node"], "left")
    return (joined.join(most, keys) if keys else joined.crossJoin(F.broadcast(most))).select(*keys, "node", F.when(F.col("inner"), F.col("depth")).otherwise(F.col("most")).alias("rank"))


def last_of_kind(nodes: DataFrame, edges: DataFrame, kind: str, keys: list[str] = KEYS) -> DataFrame:
    """Nodes of a kind that have no child of the same kind."""
    child = nodes.select(*keys, F.col("node").alias("child"), F.col(kind).alias("ck"))
    same = edges.join(child, [*keys, "child"]).join(nodes.select(*keys, F.col("node").alias("parent"), F.col(kind).alias("pk")), [*keys, "parent"]).where("ck = pk")
    return nodes.join(same.select(*keys, F.col("parent").alias("node")).distinct(), [*keys, "node"], "left_anti")


def last_instance(nodes: DataFrame, edges: DataFrame, kind: str, steps: int, keys: list[str] = KEYS) -> DataFrame:
    """(keys, node, last): follow the first child of equal kind to the end by pointer doubling.

    A chain of over 2**steps links (or a cycle) is an error when the row is computed, not a wrong end.
    """
    child = nodes.select(*keys, F.col("node").alias("child"), F.col(kind).alias("ck"))
    mine = nodes.select(*keys, F.col("node").alias("parent"), F.col(kind).alias("pk"))
    first = edges.join(child, [*keys, "child"]).join(mine, [*keys, "parent"]).where("ck = pk").groupBy(*keys, "parent").agg(F.min("child").alias("next"))
    jump = nodes.join(first.withColumnRenamed("parent", "node"), [*keys, "node"], "left").select(*keys, "node", F.coalesce("next", "node").alias("last"))
    for _ in range(steps):
        further = jump.select(*keys, F.col("node").alias("last"), F.col("last").alias("after"))
        jump = jump.join(further, [*keys, "last"], "left").select(*keys, "node", F.coalesce("after", "last").alias("last"))
    goes_on = first.select(*keys, F.col("parent").alias("last"), F.lit(True).alias("goes_on"))
    ended = jump.join(goes_on, [*keys, "last"], "left")
    return ended.select(*keys, "node", F.when(F.col("goes_on"), F.raise_error(F.lit(f"a chain of over {2**steps} links")).cast(jump.schema["last"].dataType)).otherwise(F.col("last")).alias("last"))


def shared_ends(ends: DataFrame, kinds: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(kind_a, kind_b, n): how often two roots of these kinds share a leaf, counted in both orders."""
    named = ends.join(kinds.withColumnRenamed("node", "start"), [*keys, "start"])
    a = named.select(*keys, "node", F.col("start").alias("sa"), F.col("kind").alias("kind_a"))
    b = named.select(*keys, "node", F.col("start").alias("sb"), F.col("kind").alias("kind_b"))
    return a.join(b, [*keys, "node"]).where("sa <> sb").groupBy("kind_a", "kind_b").agg(F.count("*").alias("n"))


def hop_distance(nodes: DataFrame, edges: DataFrame, most: int, keys: list[str] = KEYS) -> DataFrame:
    """(keys, start, node, hops): fewest undirected steps up to `most`."""
    both = edges.select(*keys, "parent", "child").union(edges.select(*keys, F.col("child"), F.col("parent")))
    reached = descendants(nodes.select(*keys, F.col("node").alias("start")), both, most, keys)
    return reached.groupBy(*keys, "start", "node").agg(F.min("depth").alias("hops"))


def showers(nodes: DataFrame, edges: DataFrame, excluded: Column, keys: list[str], keep) -> DataFrame:
    """(keys, start, node): all that each root reaches after the excluded nodes are taken out; a node may be in several showers."""
    kept = keep(nodes.where(~excluded).select(*keys, "node").distinct())
    inner = edges.join(kept.withColumnRenamed("node", "parent"), [*keys, "parent"], "left_semi").join(kept.withColumnRenamed("node", "child"), [*keys, "child"], "left_semi").select(*keys, "parent", "child")
    inner = keep(inner)
    starts = roots(kept, inner, keys).withColumnRenamed("node", "start")
    return walk(starts, inner, keys, keep).select(*keys, "start", "node").distinct()


def shower_facts(reached: DataFrame, labels: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, n, n_ends, flavour): size of each shower, how many of its nodes have no child, and its root's label."""
    inner = edges.select(*keys, F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    sizes = reached.join(inner, [*keys, "node"], "left").groupBy(*keys, "start").agg(F.count("*").alias("n"), F.count(F.when(F.col("inner").isNull(), 1)).alias("n_ends"))
    flavour = labels.groupBy(*keys, F.col("node").alias("start")).agg(F.array_join(F.sort_array(F.collect_set("label")), "+").alias("flavour"))
    return sizes.join(flavour, [*keys, "start"], "left")


def nearest_of_kind(starts: DataFrame, edges: DataFrame, of_kind: DataFrame, keys: list[str], keep) -> DataFrame:
    """(keys, start, node, depth): the nearest ancestor that is in `of_kind` (ties: the lowest), for starts that have one.

    A start does not count as its own ancestor; the walk goes up to the roots.
    """
    up = edges.select(*keys, F.col("child").alias("parent"), F.col("parent").alias("child"))
    above = walk(starts, up, keys, keep).where("depth > 0").join(of_kind.select(*keys, "node").distinct(), [*keys, "node"], "left_semi")
    return above.groupBy(*keys, "start").agg(F.min(F.struct("depth", "node")).alias("b")).select(*keys, "start", "b.node", "b.depth")
