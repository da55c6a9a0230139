"""Connected components of an edge table, without ever gathering the graph in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


class Forest:
    """Union-find over the positions 0..n-1 whose roots are always the smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def flatten(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Add many links; only those between different trees cost a Python step."""
        root = self.flatten()
        apart = root[a] != root[b]
        if not apart.any():
            return
        pairs = np.unique(np.stack([root[a[apart]], root[b[apart]]], 1), axis=0)
        for x, y in pairs.tolist():
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
        self.flatten()


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each Arrow batch by a spanning star of each of its trees."""
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(ids))
        forest.join(at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(forest.root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[forest.root[moved]])], ["a", "b"])


def _stars(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the smallest node around it (large star)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    up = both.filter("b > a").join(least, F.col("a") == F.col("n"))
    return up.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them (small star); a > b in `edges`."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    down = edges.join(least, F.col("a") == F.col("n")).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edge table (a long, b long); component is the smallest node reachable.

    Self-loops, repeated edges and either direction are allowed; nulls are ignored; an empty table gives
    an empty result. Batches first shrink to spanning stars, then alternate large-star and small-star
    rounds (map-side minima, joins that AQE can split at hubs) run until the edge set stands still. Each
    round is a table in the shared folder, so a lost executor repeats one round at most. It raises if
    `max_rounds` do not suffice, rather than returning something unfinished.
    """
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b")
    stored = scratch.keep(clean)  # edges often come from Python, and two workers for a task would double its memory
    now = scratch.keep(stored.mapInArrow(_thin, "a long, b long").distinct())
    scratch.drop(stored)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") / F.lit(2.0**40)).cast("decimal(38,6)"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = None
    for _ in range(max_rounds):
        after = scratch.keep(_small_stars(_stars(now)))
        scratch.drop(now)
        now, state = after, tuple(mark(after))[::2]
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
