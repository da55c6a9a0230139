"""Queries of statistics, fits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, stats
from ..sources.particles import PARTICLES_SQL as P
from ..sources.particles import particles, table
from .registry import query, r


@query("p_rand", f"""WITH {P}, c AS (SELECT event_id, track, tower, count(*) AS n FROM particles GROUP BY ALL), s AS (SELECT event_id, sum(n * (n - 1) / 2.0e0) AS s, sum(n) AS t FROM c GROUP BY 1),
a AS (SELECT event_id, sum(n * (n - 1) / 2.0e0) AS a FROM (SELECT event_id, track, sum(n) AS n FROM c GROUP BY ALL) GROUP BY 1), b AS (SELECT event_id, sum(n * (n - 1) / 2.0e0) AS b FROM (SELECT event_id, tower, sum(n) AS n FROM c GROUP BY ALL) GROUP BY 1),
e AS (SELECT event_id, s, a, b, CASE WHEN t > 1 THEN a * b / (t * (t - 1) / 2.0e0) ELSE 0 END AS x FROM s JOIN a USING (event_id) JOIN b USING (event_id))
SELECT event_id, round(CASE WHEN (a + b) / 2 - x = 0 THEN 1 ELSE (s - x) / ((a + b) / 2 - x) END, 4) + 0.0e0 AS rand FROM e""")
def p_rand(spark, d):
    return stats.rand_index(particles(spark, d), "track", "tower", ["event_id"]).select("event_id", r("rand").alias("rand"))


@query("p_spearman", """WITH x AS (SELECT l_returnflag AS g, CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS DOUBLE) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0e0 AS a,
 CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS DOUBLE) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0e0 AS b FROM lineitem) SELECT g, round(corr(a, b), 5) + 0.0e0 AS spearman FROM x GROUP BY g""")
def p_spearman(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    return stats.spearman(l, "l_quantity", "l_extendedprice", ["g"]).select("g", r("spearman", 5).alias("spearman"))


@query("p_roc_auc", """WITH x AS (SELECT l_linestatus AS g, l_returnflag = 'A' AS y, CAST(rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) AS DOUBLE) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2.0e0 AS r FROM lineitem),
s AS (SELECT g, sum(r) FILTER (y) AS s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM x GROUP BY g) SELECT g, round((s - p * (p + 1) / 2.0e0) / (p * q), 5) AS auc FROM s""")
def p_roc_auc(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("g"), "l_quantity", F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("y"))
    return stats.roc_auc(l, "l_quantity", "y", ["g"]).select("g", r("auc", 5).alias("auc"))


@query("p_ks", """WITH v AS (SELECT event_type AS g, value, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY ALL),
c AS (SELECT g, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM v WINDOW w AS (PARTITION BY g ORDER BY value ROWS UNBOUNDED PRECEDING)), t AS (SELECT g, sum(a) AS na, sum(b) AS nb FROM v GROUP BY g)
SELECT g, round(max(abs(ca / na - cb / nb)), 5) AS ks FROM c JOIN t USING (g) GROUP BY g""")
def p_ks(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), "value", (F.col("user_id") % 2).alias("side"))
    return stats.kolmogorov_smirnov(e, "value", "side", ["g"]).select("g", r("ks", 5).alias("ks"))


HISTOGRAM_SQL = """WITH e AS (SELECT event_type AS g, value, user_id % 2 AS side FROM events), s AS (SELECT g, min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM e GROUP BY g),
h AS (SELECT g, CASE WHEN w = 0 THEN 0 ELSE least(CAST(floor((value - lo) / w) AS BIGINT), 19) END AS bin, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM e JOIN s USING (g) GROUP BY ALL),
t AS (SELECT g, sum(a) AS na, sum(b) AS nb FROM h GROUP BY g), q AS (SELECT g, a / na AS p, b / nb AS q FROM h JOIN t USING (g))"""


@query("p_jensen_shannon", HISTOGRAM_SQL + """ SELECT g, round(sqrt(greatest(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)), 5) AS js FROM q GROUP BY g""")
def p_jensen_shannon(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), "value", (F.col("user_id") % 2).alias("side"))
    return stats.jensen_shannon(e, "value", "side", ["g"]).select("g", r("js", 5).alias("js"))


@query("p_kullback_leibler", HISTOGRAM_SQL + " SELECT g, round(sum(p * ln(p / q)), 5) + 0.0e0 AS kl FROM q WHERE p > 0 AND q > 0 GROUP BY g")
def p_kullback_leibler(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), "value", (F.col("user_id") % 2).alias("side"))
    return stats.kullback_leibler(e, "value", "side", ["g"]).select("g", r("kl", 5).alias("kl"))


@query("l_line_fit", "SELECT l_returnflag AS g, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem GROUP BY 1")
def l_line_fit(spark, d):
    l = table(spark, d, "lineitem")
    return l.groupBy(F.col("l_returnflag").alias("g")).agg(r(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"), r(F.regr_intercept("l_extendedprice", "l_quantity"), 1).alias("intercept"))


@query("l_polyfit2d")
def l_polyfit2d(spark, d):
    return geometry.polyfit2d(particles(spark, d), "pt", "rap", "energy", 2)


@query("l_closest_approach", f"""WITH {P}, p AS (SELECT event_id, idx, CAST(idx AS DOUBLE) AS x, rap AS y, m AS z, px, py, pz FROM particles WHERE idx < 4),
q AS (SELECT a.event_id, a.idx AS i, b.idx AS j, a.x - b.x AS wx, a.y - b.y AS wy, a.z - b.z AS wz, a.px AS ax, a.py AS ay, a.pz AS az, b.px AS qx, b.py AS qy, b.pz AS qz FROM p a JOIN p b ON a.event_id = b.event_id AND a.idx < b.idx),
k AS (SELECT q.*, ax * ax + ay * ay + az * az AS aa, ax * qx + ay * qy + az * qz AS ab, qx * qx + qy * qy + qz * qz AS bb, ax * wx + ay * wy + az * wz AS aw, qx * wx + qy * wy + qz * wz AS bw FROM q),
t AS (SELECT k.*, (ab * bw - bb * aw) / (aa * bb - ab * ab) AS s, (aa * bw - ab * aw) / (aa * bb - ab * ab) AS u FROM k WHERE aa * bb - ab * ab > 1e-3  *  aa  *  bb)
SELECT event_id, i, j, round((wx + s * ax - u * qx) ** 2 + (wy + s * ay - u * qy) ** 2 + (wz + s * az - u * qz) ** 2, 3) + 0.0e0 AS distance2 FROM t""")
def l_closest_approach(spark, d):
    p = particles(spark, d).where("idx < 4").select("event_id", "idx", F.col("idx").cast("double").alias("x"), F.col("rap").alias("y"), F.col("m").alias("z"), "px", "py", "pz")
    return geometry.closest_approach(p).where("not parallel").select("event_id", "i", "j", r("distance2", 3).alias("distance2"))


@query("l_vertices")
def l_vertices(spark, d):
    p = particles(spark, d).select("event_id", "idx", F.col("idx").cast("double").alias("x"), F.col("rap").alias("y"), F.col("m").alias("z"), "px", "py", "pz")
    return geometry.vertices(p, 2.0)


@query("u_stream_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def u_stream_counts(spark, d):
    """Windows over the event stream, run to the end of the available files."""
    from ..streaming.windows import run_available

    return run_available(spark, d)
