"""Queries of scalar and array expressions, filters, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import kinematics as K
from ..operators import filters, sets
from ..sources import hepmc
from ..sources.particles import PARTICLES_SQL as P
from ..sources.particles import ang_sql, particles, table
from .registry import query, r

INPUTS_SQL = P + """, kept AS (
  SELECT * FROM particles WHERE (track >= 0 OR tower >= 0) AND pt > 0.5e0 AND abs(asinh(pz / pt)) < 2.5e0
), inputs AS (
  SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY idx) - 1 AS INTEGER) AS input_idx, idx AS source_idx, pt, phi, rap AS rapidity, energy, px, py, pz FROM kept
)"""


def inputs(spark, d):
    return filters.jet_inputs(particles(spark, d), [filters.observable(), filters.pt_eta()])


@query("k_kinematics", f"""WITH {P} SELECT event_id, idx, round(atan2(py, px), 4) + 0.0e0 AS phi, round(sqrt(px * px + py * py), 4) AS pt, round(atan2(sqrt(px * px + py * py), pz), 4) AS theta,
 round(asinh(pz / sqrt(px * px + py * py)), 4) + 0.0e0 AS pseudorapidity, round(rap, 4) + 0.0e0 AS rapidity FROM particles""")
def k_kinematics(spark, d):
    df = K.add_all(particles(spark, d).select("event_id", "idx", "px", "py", "pz", "energy"))
    return df.select("event_id", "idx", *(r(c).alias(c) for c in ("phi", "pt", "theta", "pseudorapidity", "rapidity")))


@query("k_mass", f"WITH {P} SELECT event_id, round(sqrt(greatest(sum(energy) ** 2 - sum(px) ** 2 - sum(py) ** 2 - sum(pz) ** 2, 0)), 2) AS mass FROM particles GROUP BY event_id HAVING count(*) > 1")
def k_mass(spark, d):
    rows = particles(spark, d).groupBy("event_id").agg(*(F.sum(c).alias(c) for c in ("energy", "px", "py", "pz")), F.count("*").alias("n")).where("n > 1")
    return rows.select("event_id", r(K.clipped_mass(*(F.col(c) for c in ("energy", "px", "py", "pz"))), 2).alias("mass"))


@query("k_angles", f"""WITH {P}, x AS (SELECT event_id, idx, phi * 3 AS a, phi - rap * 2 AS b FROM particles)
SELECT event_id, idx, round((a + 3.141592653589793e0) - 6.283185307179586e0 * floor((a + 3.141592653589793e0) / 6.283185307179586e0) - 3.141592653589793e0, 4) + 0.0e0 AS wrapped, round({ang_sql('a', 'b')}, 4) + 0.0e0 AS distance FROM x""")
def k_angles(spark, d):
    x = particles(spark, d).select("event_id", "idx", (F.col("phi") * 3).alias("a"), (F.col("phi") - F.col("rap") * 2).alias("b"))
    return x.select("event_id", "idx", r(K.confine_angle(F.col("a"))).alias("wrapped"), r(K.angular_distance(F.col("a"), F.col("b"))).alias("distance"))


@query("k_rescale", f"WITH {P} SELECT event_id, idx, round((1.0e0 + 0.02e0 * rap + 0.003e0 * pt + 0.0001e0 * pt * rap) * energy, 3) AS energy FROM particles")
def k_rescale(spark, d):
    f = K.polyval2d(F.col("pt"), F.col("rap"), [1.0, 0.02, 0.003, 0.0001], 1)
    return particles(spark, d).select("event_id", "idx", r(f * F.col("energy"), 3).alias("energy"))


@query("k_rest_energy", f"""WITH {P}, root AS (SELECT event_id, energy AS e, px AS x, py AS y, pz AS z FROM particles WHERE idx = 0)
SELECT p.event_id, p.idx, round(sqrt(greatest(p.energy ** 2 - p.px ** 2 - p.py ** 2 - p.pz ** 2, 0) + (p.px - x) ** 2 + (p.py - y) ** 2 + (p.pz - z) ** 2), 3) AS energy FROM particles p JOIN root USING (event_id)""")
def k_rest_energy(spark, d):
    p = particles(spark, d)
    root = p.where("idx = 0").select("event_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    m2 = F.greatest(K.mass2(*(F.col(c) for c in ("energy", "px", "py", "pz"))), F.lit(0.0))
    dp = [F.col(a) - F.col(b) for a, b in (("px", "x"), ("py", "y"), ("pz", "z"))]
    return p.join(root, "event_id").select("event_id", "idx", r(F.sqrt(m2 + dp[0] * dp[0] + dp[1] * dp[1] + dp[2] * dp[2]), 3).alias("energy"))


@query("n_l1_distance", """
SELECT a.vec_id, round(sum(abs(CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE))), 3) AS d FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) a
JOIN (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id""")
def n_l1_distance(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(after, "vec_id").select("vec_id", r(A.l1_distance(F.col("a"), F.col("b")), 3).alias("d"))


@query("n_flatten_depth", f"WITH {P} SELECT part % 50 AS g, CAST(count(*) AS BIGINT) AS n, CAST(sum(idx) AS BIGINT) AS s, 2 AS depth FROM particles GROUP BY 1")
def n_flatten_depth(spark, d):
    inner = particles(spark, d).groupBy("event_id", (F.col("part") % 50).alias("g")).agg(F.collect_list("idx").alias("l"))
    nested = inner.groupBy("g").agg(F.collect_list("l").alias("ll"))
    kind = nested.schema["ll"].dataType
    flat = nested.select("g", A.flatten_all(F.col("ll"), kind).alias("f"))
    return flat.select("g", F.size("f").cast("long").alias("n"), F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("s"), F.lit(A.depth(kind)).alias("depth"))


@query("n_match_indices", f"WITH {P} SELECT event_id, CAST(sum(pt) AS DOUBLE) AS total, count(*) AS n FROM particles WHERE track = tower GROUP BY event_id")
def n_match_indices(spark, d):
    lists = particles(spark, d).groupBy("event_id").agg(F.collect_list("pt").alias("v"), F.collect_list("track").alias("l"), F.collect_list("tower").alias("m"))
    hit = lists.select("event_id", A.match_indices(F.col("v"), F.col("l"), F.col("m")).alias("h")).where("size(h) > 0")
    return hit.select("event_id", F.aggregate("h", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("h").cast("long").alias("n"))


@query("n_condensed_pairs", """WITH n AS (SELECT CAST(c_custkey % 7 + 2 AS BIGINT) AS n, c_custkey FROM customer), p AS (
 SELECT c_custkey, n, a.range AS i, b.range AS j, row_number() OVER (PARTITION BY c_custkey ORDER BY a.range, b.range) - 1 AS k FROM n, range(0, 9) a, range(0, 9) b WHERE a.range < b.range AND b.range < n)
SELECT c_custkey, k, i, j FROM p""")
def n_condensed_pairs(spark, d):
    n = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 7 + 2).alias("n"))
    k = n.select("c_custkey", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("long") - 1)).alias("k"))
    return k.withColumn("p", A.condensed_pair(F.col("k"), F.col("n"))).select("c_custkey", "k", "p.i", "p.j")


@query("n_safe_convert", """SELECT event_id, CASE WHEN t = 'None' THEN NULL ELSE TRY_CAST(t AS DOUBLE) END AS number, CASE WHEN t = 'None' THEN 'null' WHEN lower(t) IN ('false', 'f', 'no', 'n', '0', '') THEN 'false' ELSE 'true' END AS flag
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'None' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'No' WHEN 3 THEN 'true' ELSE '0' END AS t FROM events)""")
def n_safe_convert(spark, d):
    t = F.when(F.col("event_id") % 5 == 0, "None").when(F.col("event_id") % 5 == 1, F.col("event_id").cast("string")).when(F.col("event_id") % 5 == 2, "No").when(F.col("event_id") % 5 == 3, "true").otherwise("0")
    return table(spark, d, "events").select("event_id", A.safe_convert(t, "double").alias("number"), F.coalesce(A.safe_convert(t, "boolean").cast("string"), F.lit("null")).alias("flag"))


@query("n_name_match", "SELECT p_partkey, p_name LIKE '%a%' OR p_name LIKE '%e%' AS some, p_brand IN ('Brand#1', 'Brand#11') AS exact FROM part")
def n_name_match(spark, d):
    return table(spark, d, "part").select("p_partkey", A.contains_name(F.col("p_name"), ["a", "e"], True).alias("some"), A.contains_name(F.col("p_brand"), ["Brand#1", "Brand#11"], False).alias("exact"))


@query("f_jet_inputs", f"WITH {INPUTS_SQL} SELECT event_id, input_idx, source_idx, round(pt, 4) AS pt, round(energy, 3) AS energy FROM inputs")
def f_jet_inputs(spark, d):
    return inputs(spark, d).select("event_id", "input_idx", "source_idx", r("pt").alias("pt"), r("energy", 3).alias("energy"))


@query("f_jet_cut", f"""WITH {P}, c AS (SELECT *, max(pt) OVER (PARTITION BY event_id) AS lead_pt FROM particles)
SELECT event_id, idx, pt FROM c WHERE lead_pt > 30 AND pt > 15 AND idx % 4 + 1 >= 2""")
def f_jet_cut(spark, d):
    return filters.jet_cut(particles(spark, d).withColumn("n_tracks", F.col("idx") % 4 + 1), 30, 15, 2).select("event_id", "idx", "pt")


@query("f_low_pt", f"WITH {P} SELECT event_id, count(*) AS n FROM particles WHERE pt < 10 GROUP BY event_id")
def f_low_pt(spark, d):
    return particles(spark, d).where("pt < 10").groupBy("event_id").agg(F.count("*").alias("n"))


@query("f_tachyons", f"WITH {P} SELECT event_id, idx FROM particles WHERE (energy * (1 - idx * 0.05e0)) ** 2 - px ** 2 - py ** 2 - pz ** 2 < -50")
def f_tachyons(spark, d):
    rows = particles(spark, d).withColumn("energy", F.col("energy") * (1 - F.col("idx") * 0.05))
    return filters.tachyons(rows, 50.0).select("event_id", "idx")


@query("f_even_length", """SELECT name, n_events, max(n_events) OVER () AS most, n_events = max(n_events) OVER () AS even FROM (
 SELECT 'orders' AS name, count(DISTINCT o_orderkey) AS n_events FROM orders UNION ALL SELECT 'lineitem', count(DISTINCT l_orderkey) FROM lineitem)""")
def f_even_length(spark, d):
    return filters.uneven_events(("orders", table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))), ("lineitem", table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id")))).select("name", "n_events", "most", "even")


@query("f_cone", f"""WITH {INPUTS_SQL}, seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pt DESC, input_idx) AS r FROM inputs) WHERE r = 1 AND pt > 5)
SELECT i.event_id, i.input_idx FROM inputs i JOIN seeds s USING (event_id) WHERE ({ang_sql('i.phi', 's.phi')}) ** 2 + (i.rapidity - s.rapidity) ** 2 < 1""")
def f_cone(spark, d):
    i = inputs(spark, d)
    return filters.cone_content(i, filters.seeds(i, 5.0), 1.0).select("event_id", "input_idx")


@query("x_split", f"WITH {P} SELECT CAST(CASE WHEN event_id >= 20000 THEN 2 WHEN event_id >= 5000 THEN 1 ELSE 0 END AS INTEGER) AS part, count(*) AS n, count(DISTINCT event_id) AS events FROM particles GROUP BY 1")
def x_split(spark, d):
    return sets.split_by_bounds(particles(spark, d), "event_id", [5000, 20000]).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


@query("x_combine", f"WITH {P} SELECT event_id, count(*) AS n, CAST(sum(pt) AS DOUBLE) AS pt FROM particles GROUP BY event_id")
def x_combine(spark, d):
    p = sets.split_evenly(particles(spark, d).select("event_id", "pt"), "event_id", 3)
    parts = [p.where(F.col("part") == k).drop("part") for k in range(3)]
    return sets.combine(parts).groupBy("event_id").agg(F.count("*").alias("n"), F.sum("pt").alias("pt"))


@query("x_unfinished", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def x_unfinished(spark, d):
    todo = sets.split_unfinished(table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id")))[1]
    return todo.select("event_id")


@query("x_shared_missing", """SELECT l_partkey AS part, max(CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN l_suppkey % 2 = 1 THEN 1 ELSE 0 END) = 1 AS both,
 max(CASE WHEN l_suppkey % 2 = 1 THEN 1 ELSE 0 END) = 0 AS only_even FROM lineitem GROUP BY l_partkey""")
def x_shared_missing(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey")
    even, odd = rows.where("l_suppkey % 2 = 0").select("part").distinct(), rows.where("l_suppkey % 2 = 1").select("part").distinct()
    both = sets.shared(even, odd, ["part"]).withColumns({"both": F.lit(True), "only_even": F.lit(False)})
    only = sets.missing(even, odd, ["part"]).withColumns({"both": F.lit(False), "only_even": F.lit(True)})
    rest = sets.missing(odd, even, ["part"]).withColumns({"both": F.lit(False), "only_even": F.lit(False)})
    return sets.combine([both, only, rest])


@query("x_weighted_settings", "SELECT o_orderpriority AS param, round(sum(o_totalprice * (o_orderkey % 9 + 1)) / sum(o_orderkey % 9 + 1), 4) AS value FROM orders GROUP BY 1")
def x_weighted_settings(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("param"), F.col("o_totalprice").alias("value"), (F.col("o_orderkey") % 9 + 1).alias("length"))
    return sets.weighted_settings(s).select("param", r("value").alias("value"))


@query("s_hepmc_round_trip", f"WITH {P} SELECT event_id, idx, mcpid, round(px, 4) + 0.0e0 AS px, round(energy, 3) AS energy FROM particles")
def s_hepmc_round_trip(spark, d):
    lines = hepmc.to_lines(particles(spark, d).withColumn("start_vertex", F.lit(-1)))
    return hepmc.from_lines(lines)["particles"].select("event_id", "idx", "mcpid", r("px").alias("px"), r("energy", 3).alias("energy"))


@query("s_summary_lines", f"WITH {INPUTS_SQL} SELECT event_id, input_idx, CAST(length(CAST(input_idx AS VARCHAR)) AS INTEGER) AS width, 5 AS fields FROM inputs")
def s_summary_lines(spark, d):
    i = inputs(spark, d)
    line = F.concat_ws(" ", "input_idx", "px", "py", "pz", "energy")
    parts = F.split(line, " ")
    return i.select("event_id", F.get(parts, F.lit(0)).cast("int").alias("input_idx"), F.length(F.get(parts, F.lit(0))).alias("width"), F.size(parts).alias("fields"))


@query("s_json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def s_json_props(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("b_folds", None)
def b_folds(spark, d):
    return sets.folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5).groupBy("fold").agg(F.count("*").alias("n"))
