"""Ideal jets from the truth, and found objects against true ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clustering import per_group


def ideal_jets(inputs: DataFrame, showers: DataFrame) -> DataFrame:
    """(event_id, input_idx, shower): each visible input to the shower it belongs to; among several, the most parallel root.

    `showers` has (event_id, shower, input_idx, root_px, root_py, root_rapidity). Ties go to the lowest shower.
    """
    both = inputs.select("event_id", "input_idx", "px", "py", "rapidity").join(showers, ["event_id", "input_idx"])
    dot = F.col("px") * F.col("root_px") + F.col("py") * F.col("root_py") + F.col("rapidity") * F.col("root_rapidity")
    size = lambda a, b, c: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b) + F.col(c) * F.col(c))
    cosine = dot / F.nullif(size("px", "py", "rapidity") * size("root_px", "root_py", "root_rapidity"), F.lit(0.0))
    w = Window.partitionBy("event_id", "input_idx").orderBy(F.round(cosine, 9).desc_nulls_last(), "shower")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").select("event_id", "input_idx", "shower")


def hit_grid(showers: DataFrame, jets: DataFrame) -> DataFrame:
    """(event_id, shower, jet, n): how many inputs a shower and a jet share."""
    return showers.join(jets, ["event_id", "input_idx"]).groupBy("event_id", "shower", "jet").agg(F.count("*").alias("n"))


def match_points(found: DataFrame, true: DataFrame) -> DataFrame:
    """(event_id, found, true, distance): closest pairs first, each point once; what is left over has -1 on the other side.

    Found points without a true one are imagined, true ones without a found one are missed.
    """
    f = found.select("event_id", F.lit(0).alias("side"), F.col("idx").cast("long").alias("idx"), "x", "y", "z")
    t = true.select("event_id", F.lit(1).alias("side"), F.col("idx").cast("long").alias("idx"), "x", "y", "z")

    def kernel(e: dict) -> dict:
        at = np.stack([e["x"], e["y"], e["z"]], 1)
        a, b = np.flatnonzero(e["side"] == 0), np.flatnonzero(e["side"] == 1)
        d = np.sqrt(((at[a][:, None] - at[b][None, :]) ** 2).sum(-1))
        rows, free_a, free_b = [], set(range(len(a))), set(range(len(b)))
        for k in d.ravel().argsort(kind="stable"):
            i, j = divmod(int(k), len(b))
            if i in free_a and j in free_b:
                rows.append((e["idx"][a[i]], e["idx"][b[j]], d[i, j]))
                free_a.remove(i)
                free_b.remove(j)
        rows += [(e["idx"][a[i]], -1, np.nan) for i in sorted(free_a)] + [(-1, e["idx"][b[j]], np.nan) for j in sorted(free_b)]
        return {"event_id": np.full(len(rows), e["event_id"][0]), "found": np.array([x[0] for x in rows]), "true": np.array([x[1] for x in rows]), "distance": np.array([x[2] for x in rows], float)}

    return per_group(f.union(t), ["event_id"], ["side", "idx"], ["side", "idx", "x", "y", "z"], kernel, "event_id long, found long, true long, distance double")
