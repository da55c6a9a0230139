"""Lines in space, vertices and surface fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import per_group


def closest_approach(lines: DataFrame) -> DataFrame:
    """(event_id, i, j, s, u, distance2, mid_*, parallel) of each pair of lines (x, y, z) + t (px, py, pz).

    Nearly parallel lines have no single closest point: they get the distance of the first line's
    point from the second line.
    """
    cols = ["x", "y", "z", "px", "py", "pz"]
    a = lines.select("event_id", F.col("idx").alias("i"), *(F.col(c).alias(f"a_{c}") for c in cols))
    b = lines.select("event_id", F.col("idx").alias("j"), *(F.col(c).alias(f"b_{c}") for c in cols))
    q = a.join(b, "event_id").where("i < j")
    dot = lambda u, v: sum((F.col(f"{u[0]}_{x}") * F.col(f"{v[0]}_{y}") for x, y in zip(u[1], v[1], strict=True)), F.lit(0.0))
    p = ["px", "py", "pz"]
    q = q.withColumns({f"w_{c}": F.col(f"a_{c}") - F.col(f"b_{c}") for c in "xyz"})
    q = q.withColumns({"aa": dot(("a", p), ("a", p)), "ab": dot(("a", p), ("b", p)), "bb": dot(("b", p), ("b", p)), "aw": dot(("a", p), ("w", "xyz")), "bw": dot(("b", p), ("w", "xyz"))})
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    q = q.withColumn("parallel", det <= 1e-3 * F.col("aa") * F.col("bb")).withColumn("det", F.when(F.col("parallel"), None).otherwise(det))
    q = q.withColumns({"s": F.coalesce((F.col("ab") * F.col("bw") - F.col("bb") * F.col("aw")) / F.col("det"), F.lit(0.0)), "u": F.coalesce((F.col("aa") * F.col("bw") - F.col("ab") * F.col("aw")) / F.col("det"), F.col("bw") / F.when(F.col("bb") > 0, F.col("bb")), F.lit(0.0))})
    gap = {c: F.col(f"w_{c}") + F.col("s") * F.col(f"a_p{c}") - F.col("u") * F.col(f"b_p{c}") for c in "xyz"}
    mid = {c: (F.col(f"a_{c}") + F.col("s") * F.col(f"a_p{c}") + F.col(f"b_{c}") + F.col("u") * F.col(f"b_p{c}")) / 2 for c in "xyz"}
    return q.select("event_id", "i", "j", "s", "u", sum((g * g for g in gap.values()), F.lit(0.0)).alias("distance2"), *(m.alias(f"mid_{c}") for c, m in mid.items()), "parallel")


def vertices(lines: DataFrame, threshold: float) -> DataFrame:
    """(event_id, vertex, x, y, z, n): midpoints of greedy track pairs, joined while closer than the threshold; nearest to the origin first."""
    near = closest_approach(lines).select("event_id", "i", "j", "distance2", F.col("mid_x").alias("x"), F.col("mid_y").alias("y"), F.col("mid_z").alias("z"))

    def kernel(e: dict) -> dict:
        used, points = set(), []
        for k in e["distance2"].argsort(kind="stable"):
            if e["i"][k] not in used and e["j"][k] not in used:
                used |= {e["i"][k], e["j"][k]}
                points.append((e["x"][k], e["y"][k], e["z"][k]))
        points = np.array(points)
        label = np.arange(len(points))
        for a in range(len(points)):
            for b in range(a):
                if np.linalg.norm(points[a] - points[b]) < threshold:
                    label[label == label[a]] = label[b]
        groups = [points[label == k] for k in np.unique(label)]
        groups.sort(key=lambda g: float(np.linalg.norm(g.mean(0))))
        centre = np.array([g.mean(0) for g in groups]).reshape(-1, 3)
        return {"event_id": np.full(len(groups), e["event_id"][0]), "vertex": np.arange(len(groups)), "x": centre[:, 0], "y": centre[:, 1], "z": centre[:, 2], "n": np.array([len(g) for g in groups])}

    return per_group(near, ["event_id"], ["i", "j"], ["i", "j", "distance2", "x", "y", "z"], kernel, "event_id long, vertex int, x double, y double, z double, n int")


def polyfit2d(rows: DataFrame, x: str, y: str, z: str, order: int) -> DataFrame:
    """(i, j, coefficient) of the least-squares surface; the normal equations are one aggregate row."""
    terms = [(i, j) for i in range(order + 1) for j in range(order + 1)]
    power = lambda i, j: F.pow(F.col(x), F.lit(float(i))) * F.pow(F.col(y), F.lit(float(j)))
    needed = sorted({(a[0] + b[0], a[1] + b[1]) for a in terms for b in terms})
    sums = rows.agg(*(F.sum(power(i, j)).alias(f"m{i}_{j}") for i, j in needed), *(F.sum(power(i, j) * F.col(z)).alias(f"v{i}_{j}") for i, j in terms)).first()
    matrix = np.array([[sums[f"m{a[0] + b[0]}_{a[1] + b[1]}"] or 0.0 for b in terms] for a in terms])
    found = np.linalg.lstsq(matrix, np.array([sums[f"v{i}_{j}"] or 0.0 for i, j in terms]), rcond=None)[0]
    return rows.sparkSession.createDataFrame([(i, j, float(c)) for (i, j), c in zip(terms, found, strict=True)], "i int, j int, coefficient double")
