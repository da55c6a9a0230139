"""Queries of tags, trees, scores over datasets, stored settings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clustering, graph, masses, pairs, stats, tags, trees, truth
from ..operators.ranges import running_sums
from ..session import keeper, shared_folder
from ..sources import catalog, text
from ..sources.particles import PARTICLES_SQL as P
from ..sources.particles import ang_sql, particles, table
from .columns import INPUTS_SQL, inputs
from .graphs import WALK_SQL, _chain, _graph
from .registry import query, r
from .relations import PAIRS_SQL


@query("t_tag_particles", f"""WITH {P}, n AS (SELECT event_id, idx, abs(mcpid) >= 2 AS tag, lag(mcpid) OVER (PARTITION BY event_id ORDER BY idx) AS before FROM particles),
g AS (SELECT *, sum(CASE WHEN tag THEN 0 ELSE 1 END) OVER (PARTITION BY event_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT event_id, max(idx) AS node FROM g WHERE tag GROUP BY event_id, run HAVING max(CASE WHEN before IS NULL OR abs(before) <= 3 THEN 1 ELSE 0 END) = 1""")
def t_tag_particles(spark, d):
    p, e = _chain(spark, d)
    return tags.tag_particles(p, e, F.abs("mcpid") >= 2, F.abs("mcpid") <= 3, keeper(spark)).select("event_id", "node")


@query("t_detectable", f"WITH {P} SELECT event_id, track AS tag, round(sum(energy), 3) AS energy, round(sum(px), 3) + 0.0e0 AS px, count(*) AS n FROM particles WHERE track >= 0 AND tower >= 0 GROUP BY ALL")
def t_detectable(spark, d):
    p = particles(spark, d)
    leaves = p.where("track >= 0").select("event_id", F.col("track").alias("tag"), F.col("idx").alias("leaf"))
    return tags.detectable(leaves, p.where("tower >= 0")).select("event_id", "tag", r("energy", 3).alias("energy"), r("px", 3).alias("px"), "n")


@query("t_tag_groups")
def t_tag_groups(spark, d):
    p = particles(spark, d).where("track >= 0")
    return tags.tag_groups(p.select("event_id", F.col("idx").alias("tag"), F.col("track").alias("leaf")).union(p.select("event_id", F.col("idx").alias("tag"), (F.col("tower") + 10).alias("leaf"))))


@query("t_inheritance", f"""WITH {P}, s AS (SELECT event_id, track AS tag, tower AS jet, sum(energy) AS e FROM particles WHERE track >= 0 AND tower >= 0 GROUP BY ALL), t AS (SELECT event_id, tower AS jet, sum(energy) AS total FROM particles WHERE tower >= 0 GROUP BY ALL)
SELECT s.event_id, tag, s.jet, round(e / total, 4) AS share, row_number() OVER (PARTITION BY s.event_id, tag ORDER BY round(e, 6) DESC, s.jet) = 1 AS best FROM s JOIN t ON s.event_id = t.event_id AND s.jet = t.jet""")
def t_inheritance(spark, d):
    p = particles(spark, d)
    jets = p.where("tower >= 0").select("event_id", F.col("tower").alias("jet"), F.col("idx").alias("leaf"), "energy")
    return tags.inheritance(jets, p.where("track >= 0").select("event_id", F.col("track").alias("tag"), F.col("idx").alias("leaf"))).select("event_id", "tag", "jet", r("share").alias("share"), "best")


@query("j_tags_to_quarks")
def j_tags_to_quarks(spark, d):
    p = particles(spark, d).withColumnRenamed("rap", "rapidity")
    return tags.tags_to_quarks(p.where("mcpid < 0"), p.where("mcpid > 2"))


@query("a_same_ancestor", f"WITH {P} SELECT a.event_id, a.supp % 7 AS ancestor, a.idx AS low, b.idx AS high FROM particles a JOIN particles b ON a.event_id = b.event_id AND a.supp % 7 = b.supp % 7 AND a.idx < b.idx AND a.tower <> b.tower")
def a_same_ancestor(spark, d):
    p = particles(spark, d).select("event_id", (F.col("supp") % 7).alias("ancestor"), F.col("idx").alias("tag"), F.col("tower").alias("jet"))
    return tags.same_ancestor_pairs(p, True)


@query("a_double_tagged", f"WITH {P} SELECT event_id, tower AS jet FROM particles WHERE tower >= 0 GROUP BY ALL HAVING count(DISTINCT idx) = 2")
def a_double_tagged(spark, d):
    return tags.with_n_tags(particles(spark, d).where("tower >= 0").select("event_id", F.col("tower").alias("jet"), F.col("idx").alias("tag")), 2)


@query("a_compared", f"""WITH {P}, t AS (SELECT event_id, sum(energy) AS e, sum(px) AS x, sum(py) AS y, count(*) AS n FROM particles WHERE track >= 0 GROUP BY 1), f AS (SELECT event_id, sum(energy) AS e, sum(px) AS x, sum(py) AS y, count(*) AS n FROM particles WHERE tower >= 0 GROUP BY 1)
SELECT t.event_id, round(abs(sqrt(t.x ** 2 + t.y ** 2) - sqrt(f.x ** 2 + f.y ** 2)), 3) AS pt_distance, round(abs(atan2(t.y, t.x) - atan2(f.y, f.x)), 3) AS phi_distance, round(f.n / t.n, 4) AS percent_found FROM t JOIN f USING (event_id)""")
def a_compared(spark, d):
    p = particles(spark, d)
    sums = lambda rows: rows.groupBy("event_id").agg(*(F.sum(c).alias(c) for c in ("energy", "px", "py", "pz")), F.count("*").alias("n"))
    return tags.compared(sums(p.where("track >= 0")), sums(p.where("tower >= 0"))).select("event_id", r("pt_distance", 3).alias("pt_distance"), r("phi_distance", 3).alias("phi_distance"), r("percent_found").alias("percent_found"))


@query("a_descendant_sums", f"""WITH RECURSIVE {WALK_SQL} SELECT w.start, count(*) AS n, round(sum(p.pt), 2) AS pt FROM walk w JOIN particles p ON w.node = 5000000000000 + p.event_id * 100 + p.idx GROUP BY 1""")
def a_descendant_sums(spark, d):
    starts, e = _graph(spark, d)
    reached = graph.walk(starts, e, [], keeper(spark)).select("start", "node").distinct()
    p = particles(spark, d).select((F.lit(5 * 10**12) + F.col("event_id") * 100 + F.col("idx")).alias("node"), "pt")
    return reached.join(p, "node").groupBy("start").agg(F.count("*").alias("n"), r(F.sum("pt"), 2).alias("pt"))


@query("a_cut_flow", f"WITH {P} SELECT count(*) AS n, count(*) FILTER (track >= 0) AS tracked, count(*) FILTER (track >= 0 AND pt > 10) AS hard, count(*) FILTER (track >= 0 AND pt > 10 AND abs(rap) < 1) AS central FROM particles")
def a_cut_flow(spark, d):
    cuts = [F.col("track") >= 0, F.col("pt") > 10, F.abs("rap") < 1]
    out, so_far = [F.count("*").alias("n")], F.lit(True)
    for name, cut in zip(("tracked", "hard", "central"), cuts, strict=True):
        so_far = so_far & cut
        out.append(F.count_if(so_far).alias(name))
    return particles(spark, d).agg(*out)


@query("a_multiplicity", f"WITH {P} SELECT o_orderkey AS event_id, count(idx) AS n, round(coalesce(avg(pt), 0), 7) AS mean_pt, round(coalesce(avg(rap), 0), 7) + 0.0e0 AS mean_rapidity FROM orders LEFT JOIN particles ON event_id = o_orderkey GROUP BY 1")
def a_multiplicity(spark, d):
    found = particles(spark, d).groupBy("event_id").agg(F.count("*").alias("n"), F.avg("pt").alias("mean_pt"), F.avg("rap").alias("mean_rapidity"))
    every = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")).join(found, "event_id", "left").fillna(0)
    return every.select("event_id", "n", r("mean_pt", 7).alias("mean_pt"), r("mean_rapidity", 7).alias("mean_rapidity"))


@query("a_pid_difference", f"WITH {P} SELECT mcpid, CAST(count(*) FILTER (event_id % 2 = 0) AS BIGINT) - count(*) FILTER (event_id % 2 = 1) AS difference FROM particles GROUP BY 1")
def a_pid_difference(spark, d):
    even = F.col("event_id") % 2 == 0
    return particles(spark, d).groupBy("mcpid").agg((F.count_if(even) - F.count_if(~even)).alias("difference"))


@query("a_class_bests", """SELECT class, name, meta FROM (SELECT c_mktsegment AS class, c_name AS name, round(-(abs(c_acctbal) + c_nationkey ** 2) / (c_nationkey + 1), 4) AS meta,
 row_number() OVER (PARTITION BY c_mktsegment ORDER BY -(abs(c_acctbal) + c_nationkey ** 2) / (c_nationkey + 1) DESC, c_name) AS r FROM customer) WHERE r = 1""")
def a_class_bests(spark, d):
    meta = -(F.abs("c_acctbal") + F.col("c_nationkey") * F.col("c_nationkey")) / (F.col("c_nationkey") + 1)
    t = table(spark, d, "customer").select(F.col("c_mktsegment").alias("class"), F.col("c_name").alias("name"), meta.alias("meta"))
    return masses.best_setting(t, "name", "meta", ["class"]).select("class", "name", r("meta").alias("meta"))


@query("a_energy_ratio", f"WITH {P}, m AS (SELECT event_id, avg(energy) AS e, avg(pt) AS p FROM particles GROUP BY 1) SELECT round(regr_slope(e, p), 4) AS slope, round(regr_intercept(e, p), 3) AS intercept, count(*) AS n FROM m")
def a_energy_ratio(spark, d):
    m = particles(spark, d).groupBy("event_id").agg(F.avg("energy").alias("e"), F.avg("pt").alias("p"))
    return m.agg(r(F.regr_slope("e", "p")).alias("slope"), r(F.regr_intercept("e", "p"), 3).alias("intercept"), F.count("*").alias("n"))


@query("d_irc_pairs", f"WITH {PAIRS_SQL} SELECT event_id, i, j, round(least(pa, pb) * cos(phi_a - phi_b), 4) + 0.0e0 AS soft, round(sqrt(d2), 4) AS delta_r FROM pairs")
def d_irc_pairs(spark, d):
    p = pairs.pairs(inputs(spark, d))
    return p.select("event_id", "i", "j", r(F.least("pt_i", "pt_j") * F.cos(F.col("phi_i") - F.col("phi_j"))).alias("soft"), r(F.sqrt(pairs.physical_distance2("angular"))).alias("delta_r"))


@query("d_pair_labels", f"WITH {P} SELECT a.event_id, a.idx AS i, b.idx AS j, a.track = b.track AND a.track >= 0 AS related FROM particles a JOIN particles b ON a.event_id = b.event_id AND a.idx < b.idx")
def d_pair_labels(spark, d):
    p = pairs.pairs(particles(spark, d), "idx", ["track"])
    return p.select("event_id", "i", "j", ((F.col("track_i") == F.col("track_j")) & (F.col("track_i") >= 0)).alias("related"))


@query("d_isolated", f"WITH {INPUTS_SQL} SELECT i.event_id, count(*) AS isolated FROM inputs i WHERE NOT EXISTS (SELECT 1 FROM inputs o WHERE o.event_id = i.event_id AND o.input_idx <> i.input_idx AND (i.rapidity - o.rapidity) ** 2 + ({ang_sql('i.phi', 'o.phi')}) ** 2 < 1) GROUP BY 1")
def d_isolated(spark, d):
    i = inputs(spark, d)
    near = pairs.pairs(i, ordered=True).where(pairs.physical_distance2("angular") < 1).select("event_id", F.col("i").alias("input_idx")).distinct()
    return i.join(near, ["event_id", "input_idx"], "left_anti").groupBy("event_id").agg(F.count("*").alias("isolated"))


@query("f_colour_flow", "SELECT l_orderkey AS vertex, code, CAST(sum(sign) AS BIGINT) AS balance FROM (SELECT l_orderkey, l_partkey % 3 AS code, 1 AS sign FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey % 3, -1 FROM lineitem) GROUP BY ALL HAVING sum(sign) <> 0")
def f_colour_flow(spark, d):
    codes = F.explode(F.array(F.struct((F.col("l_partkey") % 3).alias("code"), F.lit(1).alias("sign")), F.struct((F.col("l_suppkey") % 3).alias("code"), F.lit(-1).alias("sign"))))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("vertex"), codes.alias("c")).select("vertex", "c.code", "c.sign")
    return rows.groupBy("vertex", "code").agg(F.sum("sign").alias("balance")).where("balance <> 0")


@query("f_drop_partial", "SELECT l_shipmode AS jet_name, n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, count(*) AS n, count(DISTINCT l_orderkey) AS e FROM lineitem GROUP BY 1) WHERE e >= 100")
def f_drop_partial(spark, d):
    jets = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("jet_name"), F.col("l_orderkey").alias("event_id"))
    return catalog.drop_partial(jets, 100).groupBy("jet_name").agg(F.count("*").alias("n"))


@query("f_same_settings", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def f_same_settings(spark, d):
    c = table(spark, d, "customer")
    stored = c.select(F.col("c_name").alias("name"), F.lit("segment").alias("param"), F.col("c_mktsegment").alias("value")).union(c.select("c_name", F.lit("nation"), F.col("c_nationkey").cast("string")))
    return catalog.same_settings(stored, {"segment": "BUILDING", "nation": 3})


@query("g_simplified", f"WITH {P}, m AS (SELECT event_id, max(idx) AS m FROM particles GROUP BY 1) SELECT event_id, 0 AS parent, m AS child FROM m WHERE m > 0")
def g_simplified(spark, d):
    return trees.simplify(_chain(spark, d)[1], 5, ["event_id"]).select("event_id", "parent", "child")


@query("g_outside", f"WITH {P} SELECT event_id, idx AS node FROM particles WHERE idx >= 1 AND idx % 2 = 0")
def g_outside(spark, d):
    p, e = _chain(spark, d)
    return trees.outside_connections(p.where("node % 2 = 0").select("event_id", "node"), e, ["event_id"]).select("event_id", "node")


@query("g_amalgamated", f"WITH {P} SELECT event_id, idx, mcpid FROM particles")
def g_amalgamated(spark, d):
    p = particles(spark, d).select("event_id", "idx", "mcpid")
    return trees.amalgamate(p.where("idx < 3"), p.where("idx > 1").union(p.where("idx = 0")), ["event_id", "idx"])


@query("g_tree_leaves")
def g_tree_leaves(spark, d):
    """Leaf sets of all pseudojets of the Cambridge/Aachen trees."""
    return trees.leaf_sets(clustering.generalised_kt(inputs(spark, d), 0.8, 0.0), keeper(spark))


@query("g_tree_joins")
def g_tree_joins(spark, d):
    return trees.joins_walked(clustering.generalised_kt(inputs(spark, d), 0.8, 0.0))


@query("p_mean_gap", """WITH h AS (SELECT event_type AS g, value, user_id % 2 AS side FROM events), m AS (SELECT g, avg(value) FILTER (side = 0) AS a, avg(value) FILTER (side = 1) AS b, avg(value) AS c FROM h GROUP BY g) SELECT g, round(abs(a - b) / c, 5) AS dissimilarity FROM m""")
def p_mean_gap(spark, d):
    """The gap of two means over the common mean."""
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), "value", (F.col("user_id") % 2).alias("side"))
    m = e.groupBy("g").agg(F.avg(F.when(F.col("side") == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("side") == 1, F.col("value"))).alias("b"), F.avg("value").alias("c"))
    return m.select("g", r(F.abs(F.col("a") - F.col("b")) / F.col("c"), 5).alias("dissimilarity"))


@query("p_subsample_distance")
def p_subsample_distance(spark, d):
    """Distances between the halves of the users, in units of those within each half; rows in the order of their ids."""
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), "value", "event_id", (F.col("user_id") % 2).alias("side"))
    kinds = {"ks": stats.kolmogorov_smirnov, "js": stats.jensen_shannon, "es": stats.epps_singleton}
    parts = [stats.subsample_normalised(e, "value", "side", ["event_id"], ["g"], f).select("g", F.lit(k).alias("distance"), r("dissimilarity", 5).alias("dissimilarity")) for k, f in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("w_axis_scale", "SELECT c_nationkey AS label, dense_rank() OVER (ORDER BY c_nationkey) - 1 AS place FROM (SELECT DISTINCT c_nationkey FROM customer)")
def w_axis_scale(spark, d):
    labels = table(spark, d, "customer").select(F.col("c_nationkey").alias("label")).distinct()
    return running_sums(labels.withColumn("one", F.lit(1)), [], ["label"], {"upto": "one"}).select("label", (F.col("upto") - 1).cast("long").alias("place"))


@query("b_resume", "SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 3 <> 0")
def b_resume(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    return catalog.unfinished(o, o.where("event_id % 3 = 0"))


@query("s_metric_text", "SELECT 'Kt' AS class, 'Mass' AS variable, CAST(c_custkey + 0.5 AS DOUBLE) AS value FROM customer UNION ALL SELECT 'Cone', 'PT', CAST(-c_custkey AS DOUBLE) FROM customer")
def s_metric_text(spark, d):
    lines = table(spark, d, "customer").select(F.concat(F.lit("{'Kt3_Mass': "), (F.col("c_custkey") + F.lit(0.5)).cast("string"), F.lit(", 'Cone1_PT': "), (-F.col("c_custkey")).cast("string"), F.lit("}")).alias("line"))
    return text.metric_rows(lines)


@query("s_cluster_listing", f"WITH {P} SELECT event_id, idx AS pj_idx, -1 AS parent, idx AS input_idx, pt FROM particles")
def s_cluster_listing(spark, d):
    p = particles(spark, d)
    line = F.concat_ws(" ", "idx", F.lit("-1 -1 -1"), "idx", "pt", "rap", "phi", "energy", "px", "py", "pz")
    rows = p.select("event_id", line.alias("line")).union(p.where("idx = 0").select("event_id", F.lit("# deltaR=0.8 columns")))
    return text.cluster_listing(rows).select("event_id", "pj_idx", "parent", "input_idx", "pt")


@query("s_particle_table", "SELECT CAST(p_partkey AS INTEGER) AS id, p_name AS name, p_size / 3.0e0 AS charge FROM part UNION ALL SELECT CAST(-p_partkey AS INTEGER), p_name || 'bar', -p_size / 3.0e0 FROM part WHERE p_partkey % 2 = 0")
def s_particle_table(spark, d):
    anti = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(' antiName="'), "p_name", F.lit('bar"'))).otherwise("")
    line = F.concat(F.lit('<particle id="'), "p_partkey", F.lit('" name="'), "p_name", F.lit('"'), anti, F.lit(' spinType="2" chargeType="'), "p_size", F.lit('">'))
    return text.particle_table(table(spark, d, "part").select(line.alias("line"))).select("id", "name", "charge")


@query("c_embedding")
def c_embedding(spark, d):
    return clustering.embeddings(inputs(spark, d), 2)


@query("c_ideal_jets", f"""WITH {INPUTS_SQL}, s AS (SELECT i.event_id, i.input_idx, k.shower, p.px AS rx, p.py AS ry, p.rap AS rr, i.px, i.py, i.rapidity FROM inputs i JOIN (VALUES (0), (1)) k(shower) ON true JOIN particles p ON p.event_id = i.event_id AND p.idx = k.shower),
c AS (SELECT *, (px * rx + py * ry + rapidity * rr) / (sqrt(px * px + py * py + rapidity * rapidity) * sqrt(rx * rx + ry * ry + rr * rr)) AS c FROM s)
SELECT event_id, input_idx, shower FROM (SELECT *, row_number() OVER (PARTITION BY event_id, input_idx ORDER BY round(c, 9) DESC, shower) AS r FROM c) WHERE r = 1""")
def c_ideal_jets(spark, d):
    p, i = particles(spark, d), inputs(spark, d)
    roots = p.where("idx < 2").select("event_id", F.col("idx").alias("shower"), F.col("px").alias("root_px"), F.col("py").alias("root_py"), F.col("rap").alias("root_rapidity"))
    return truth.ideal_jets(i, i.select("event_id", "input_idx").join(roots, "event_id"))


@query("j_hit_grid", f"WITH {P} SELECT event_id, track AS shower, tower AS jet, count(*) AS n FROM particles WHERE track >= 0 AND tower >= 0 GROUP BY ALL")
def j_hit_grid(spark, d):
    p = particles(spark, d).withColumnRenamed("idx", "input_idx")
    return truth.hit_grid(p.where("track >= 0").select("event_id", "input_idx", F.col("track").alias("shower")), p.where("tower >= 0").select("event_id", "input_idx", F.col("tower").alias("jet")))


@query("j_match_vertices")
def j_match_vertices(spark, d):
    p = particles(spark, d).select("event_id", "idx", F.col("phi").alias("x"), F.col("rap").alias("y"), F.col("m").alias("z"), "part")
    return truth.match_points(p.where("part % 2 = 0"), p.where("part % 2 = 1"))


@query("p_epps_singleton")
def p_epps_singleton(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("g"), "value", (F.col("user_id") % 2).alias("side"))
    return stats.epps_singleton(e, "value", "side", ["g"])


@query("b_random_scan")
def b_random_scan(spark, d):
    """Jets per event for random settings of the sequential merging."""
    chosen = catalog.random_settings("GeneralisedKT", 3, 11, {"delta_r": (0.3, 1.2), "power": (-1.0, 1.0)})
    return clustering.scan(inputs(spark, d), chosen).groupBy("setting", "event_id").agg(F.countDistinct("jet").alias("n_jets"))


@query("s_partitioned_round_trip", f"WITH {P} SELECT mcpid, count(*) AS n, CAST(sum(pt) AS DOUBLE) AS pt FROM particles GROUP BY 1")
def s_partitioned_round_trip(spark, d):
    path = f"{shared_folder(spark)}/dataset-{uuid.uuid4().hex}"
    catalog.save(particles(spark, d).select("mcpid", "event_id", "idx", "pt").repartition("mcpid"), path, ["mcpid"])
    return spark.read.parquet(path).groupBy("mcpid").agg(F.count("*").alias("n"), F.sum("pt").alias("pt"))
