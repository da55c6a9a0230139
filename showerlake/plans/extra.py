"""Queries of jet parts, qualities, showers per root, labels, table filters and column choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kinematics as K
from ..operators import filters, graph, joins, masses, pairs, ranking, sets, tags
from ..session import keeper
from ..sources import catalog, hepmc
from ..sources.particles import EDGES_SQL, edges, particles, table
from ..sources.particles import PARTICLES_SQL as P
from .columns import inputs
from .graphs import _chain
from .registry import query, r
from .relations import MASS_SQL, PAIRS_SQL, TOP_SQL, _masses

_PARTS = ("both", "signal", "background")


@query("a_jet_parts", f"""WITH {P}, s AS (SELECT event_id, {', '.join(f"sum({c}) FILTER ({w}) AS {c}_{n}" for n, w in (('both', 'true'), ('signal', 'track >= 0'), ('background', 'track < 0')) for c in ('energy', 'px', 'py', 'pz'))} FROM particles WHERE tower >= 0 GROUP BY event_id)
SELECT o_orderkey AS event_id, {', '.join(f"round(coalesce(sqrt(greatest(energy_{n} ** 2 - px_{n} ** 2 - py_{n} ** 2 - pz_{n} ** 2, 0)), 0), 2) AS {n}" for n in _PARTS)} FROM orders LEFT JOIN s ON event_id = o_orderkey""")
def a_jet_parts(spark, d):
    p = particles(spark, d).withColumnRenamed("idx", "leaf")
    events, members, leaves = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id")), p.where("tower >= 0"), p.where("track >= 0")
    found = [masses.combined_mass(events, members, leaves, part).select("event_id", r("mass", 2).alias(part)) for part in _PARTS]
    return found[0].join(found[1], "event_id").join(found[2], "event_id")


@query("a_double_masses", f"""WITH {P} SELECT event_id, tower AS jet, round(sqrt(greatest(sum(energy) ** 2 - sum(px) ** 2 - sum(py) ** 2 - sum(pz) ** 2, 0)), 2) AS mass FROM particles WHERE tower >= 0 GROUP BY ALL HAVING count(*) = 2""")
def a_double_masses(spark, d):
    p = particles(spark, d).where("tower >= 0").withColumnRenamed("tower", "jet")
    double = tags.with_n_tags(p.select("event_id", "jet", F.col("idx").alias("tag")), 2)
    return masses.group_mass(p.join(double, ["event_id", "jet"], "left_semi"), ["event_id", "jet"]).select("event_id", "jet", r("mass", 2).alias("mass"))


@query("a_sorted_masses", f"""WITH {TOP_SQL} SELECT event_id, round(mass, 2) AS mass, row_number() OVER (ORDER BY round(mass, 2), event_id) - 1 AS place FROM pm WHERE r1 = 1 AND r2 = 2 AND round(mass, 2) > 1e-5""")
def a_sorted_masses(spark, d):
    lead = masses.leading_pair(masses.pt_pairs(particles(spark, d))).select("event_id", r("mass", 2).alias("mass"))
    return masses.sorted_masses(lead)


@query("w_quality_both", f"""WITH {MASS_SQL}, n AS (SELECT g, count(*) AS n, greatest(2, least(CAST(ceil(count(*) * 0.25e0) AS BIGINT), count(*))) AS t FROM m GROUP BY g), o AS (SELECT g, mass, row_number() OVER (PARTITION BY g ORDER BY mass, event_id) AS r FROM m),
w AS (SELECT n.g, min(b.mass - a.mass) / max(n.n) AS width_per_event FROM n JOIN o a ON a.g = n.g JOIN o b ON b.g = n.g AND b.r = a.r + n.t - 1 GROUP BY n.g),
k AS (SELECT g, count(*) OVER (PARTITION BY g ORDER BY mass RANGE BETWEEN CURRENT ROW AND 30000.0e0 FOLLOWING) - count(*) OVER (PARTITION BY g ORDER BY mass RANGE BETWEEN 30000.0e0 FOLLOWING AND 30000.0e0 FOLLOWING) AS k FROM m),
f AS (SELECT g, count(*) / CAST(max(k) AS DOUBLE) AS events_per_window FROM k GROUP BY g) SELECT g, round(width_per_event, 5) AS width_per_event, round(events_per_window, 5) AS events_per_window FROM f LEFT JOIN w USING (g)""")
def w_quality_both(spark, d):
    found = ranking.quality_width_fraction(_masses(spark, d), "g", 60000.0, 0.25, 0.5)
    return found.select("g", r("width_per_event", 5).alias("width_per_event"), r("events_per_window", 5).alias("events_per_window"))


@query("a_jet_labels", f"""WITH {P} SELECT event_id, idx, greatest(CASE WHEN track >= 0 THEN track + 10 ELSE -1 END, tower) AS jet FROM particles""")
def a_jet_labels(spark, d):
    p = particles(spark, d)
    members = p.where("tower >= 0").select("event_id", F.col("tower").alias("jet"), F.col("idx").alias("leaf")).union(p.where("track >= 0").select("event_id", F.col("track") + 10, "idx"))
    return tags.jet_labels(p, members)


@query("j_jets_to_groups", f"""WITH {P}, l AS (SELECT event_id, tower AS jet, track AS tag, sum(energy) ** 2 - sum(px) ** 2 - sum(py) ** 2 - sum(pz) ** 2 AS mass2 FROM particles WHERE tower >= 0 AND track >= 0 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id, jet ORDER BY round(mass2, 6) DESC, tag) AS k FROM l) SELECT event_id, jet, tag // 2 AS seed FROM b WHERE k = 1 AND tag < 6""")
def j_jets_to_groups(spark, d):
    p = particles(spark, d).where("tower >= 0 and track >= 0").withColumnRenamed("tower", "jet").withColumnRenamed("track", "tag")
    links = masses.share_of_mass(p).select("event_id", "jet", "tag", "mass2")
    groups = p.where("tag < 6").select("event_id", F.floor(F.col("tag") / 2).cast("int").alias("seed"), "tag").distinct()
    return tags.jets_to_groups(links, groups)


@query("g_showers", f"""WITH RECURSIVE {EDGES_SQL}, k AS (SELECT parent, child FROM edges WHERE parent >= 3000000000000), n AS (SELECT child AS node FROM edges WHERE child >= 3000000000000 UNION SELECT parent FROM k),
s AS (SELECT node FROM n WHERE node NOT IN (SELECT child FROM k)), walk AS (SELECT node AS start, node FROM s UNION SELECT w.start, k.child FROM walk w JOIN k ON k.parent = w.node)
SELECT start, count(*) AS n, count(*) FILTER (node NOT IN (SELECT parent FROM k)) AS n_ends, CASE WHEN start < 4000000000000 THEN 'customer' WHEN start < 6000000000000 THEN 'order' ELSE 'supplier' END AS flavour FROM walk GROUP BY ALL""")
def g_showers(spark, d):
    """Showers below the regions and nations, which are taken out."""
    e = edges(spark, d)
    nodes = e.select(F.col("parent").alias("node")).union(e.select("child")).distinct()
    reached = graph.showers(nodes, e, F.col("node") < 3 * 10**12, [], keeper(spark))
    label = F.when(F.col("node") < 4 * 10**12, "customer").when(F.col("node") < 6 * 10**12, "order").otherwise("supplier")
    return graph.shower_facts(reached, nodes.select("node", label.alias("label")), e.where("parent >= 3000000000000"), []).select("start", "n", "n_ends", "flavour")


@query("f_end_state", f"WITH {P} SELECT event_id, max(idx) AS idx FROM particles GROUP BY event_id")
def f_end_state(spark, d):
    p, e = _chain(spark, d)
    return filters.end_state(p.withColumnRenamed("node", "idx"), e).select("event_id", "idx")


@query("f_seeds", f"""WITH {P} SELECT event_id, idx AS input_idx, pt FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pt DESC, idx) AS k FROM particles) WHERE k = 1 AND pt > 20""")
def f_seeds(spark, d):
    return filters.seeds(particles(spark, d).withColumnRenamed("idx", "input_idx").withColumnRenamed("rap", "rapidity"), 20.0).select("event_id", "input_idx", "pt")


_SCORES_SQL = "SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN CAST('nan' AS DOUBLE) ELSE c_acctbal END AS score, CAST(NULL AS DOUBLE) AS empty FROM customer"


def _scores(spark, d):
    score = F.when(F.col("c_custkey") % 3 == 0, float("nan")).otherwise(F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", score.alias("score"), F.lit(None).cast("double").alias("empty"))


@query("f_score_table", f"SELECT c_custkey, c_nationkey, c_acctbal, score FROM ({_SCORES_SQL}) WHERE c_custkey % 3 <> 0")
def f_score_table(spark, d):
    return filters.without_empty_columns(filters.without_empty_rows(_scores(spark, d), ["score", "empty"]), ["score", "empty"])


@query("f_matching", f"SELECT c_custkey FROM ({_SCORES_SQL}) WHERE c_nationkey = 7 AND abs(c_acctbal - 5000) <= 1e-8 + 0.5e0 * 5000")
def f_matching(spark, d):
    return filters.matching(_scores(spark, d), {"c_nationkey": 7}, {"c_acctbal": 5000.0}, rtol=0.5).select("c_custkey")


@query("f_remove_scores", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'DeltaR' WHEN 1 THEN 'QualityWidth' WHEN 2 THEN 'AveBGMassRatio' ELSE 'Width' END AS param FROM customer WHERE c_custkey % 4 IN (0, 3)")
def f_remove_scores(spark, d):
    names = F.element_at(F.array(*(F.lit(n) for n in ("DeltaR", "QualityWidth", "AveBGMassRatio", "Width"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return catalog.remove_scores(table(spark, d, "customer").select("c_custkey", names.alias("param")), ["QualityWidth", "MassRatio"])


@query("k_theta_choice", f"""WITH {P} SELECT event_id, idx, round(acos(pz / sqrt(px ** 2 + py ** 2 + pz ** 2)), 5) AS by_birr, round(atan2(pt, pz), 5) AS by_pt, round(atan2(sqrt(px ** 2 + py ** 2), pz), 5) AS by_parts FROM particles""")
def k_theta_choice(spark, d):
    p = particles(spark, d).withColumn("birr", K.momentum(F.col("px"), F.col("py"), F.col("pz")))
    kinds = {"by_birr": ["birr", "pt", "px", "py", "pz"], "by_pt": ["pt", "px", "py", "pz"], "by_parts": ["px", "py", "pz"]}
    return p.select("event_id", "idx", *(r(K.chosen_theta(columns), 5).alias(name) for name, columns in kinds.items()))


@query("k_event_mass", f"""WITH {P}, s AS (SELECT event_id, sum(energy) ** 2 - sum(px) ** 2 - sum(py) ** 2 - sum(pz) ** 2 AS m2, count(*) AS n FROM particles GROUP BY event_id)
SELECT event_id, round(sqrt(m2), 2) AS mass FROM s WHERE n > 1 AND m2 > 1""")
def k_event_mass(spark, d):
    sums = particles(spark, d).groupBy("event_id").agg(*(F.sum(c).alias(c) for c in masses.MOMENTA), F.count("*").alias("n"))
    parts = [F.col(c) for c in masses.MOMENTA]
    return sums.where((F.col("n") > 1) & (K.mass2(*parts) > 1)).select("event_id", r(K.event_mass(*parts), 2).alias("mass"))


@query("k_flat_jet_mass", f"""WITH {P}, s AS (SELECT event_id, tower AS jet, sum(energy) AS e, sqrt(sum(px) ** 2 + sum(py) ** 2) AS t, sum(pz) AS z FROM particles WHERE tower >= 0 GROUP BY ALL HAVING count(*) > 1)
SELECT event_id, jet, round(sqrt(e * e - t * t - z * z), 2) AS mass FROM s WHERE e * e - t * t - z * z > 1""")
def k_flat_jet_mass(spark, d):
    p = particles(spark, d).where("tower >= 0")
    roots = p.groupBy("event_id", F.col("tower").alias("jet")).agg(*(F.sum(c).alias(c) for c in masses.MOMENTA), F.count("*").alias("n")).where("n > 1")
    mass = K.flat_jet_mass(F.col("energy"), K.pt(F.col("px"), F.col("py")), F.col("pz"))
    return roots.withColumn("mass", mass).where("mass > 1").select("event_id", "jet", r("mass", 2).alias("mass"))


@query("s_columns", f"WITH {P} SELECT event_id, idx AS \"Idx\", pt AS jet_pt, 2 * pt AS \"Double_pt\" FROM particles")
def s_columns(spark, d):
    """Columns appended, renamed one by one and by prefix, and removed by prefix."""
    p = particles(spark, d).select("event_id", F.col("idx").alias("place"), F.col("pt").alias("old_pt"), F.col("phi").alias("tmp_phi"), F.col("rap").alias("tmp_rap"))
    p = catalog.append(p, ["DeltaR"], double_pt=2 * F.col("old_pt"))
    return catalog.rename(catalog.remove_prefix(catalog.rename_prefix(p, "old_", "jet_"), "tmp_"), {"place": "Idx"})


@query("j_donated", f"WITH {P} SELECT event_id, idx, pt, NULL AS mass FROM particles UNION ALL SELECT o_orderkey, 0, NULL, o_totalprice FROM orders")
def j_donated(spark, d):
    jets = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit(0).alias("idx"), F.col("o_totalprice").alias("mass"))
    return joins.union_datasets(particles(spark, d).select("event_id", "idx", "pt"), jets)


@query("x_common_columns", "SELECT c_nationkey AS nationkey, 'customer' AS side FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def x_common_columns(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("side"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nationkey"), "s_suppkey")
    common = sets.common_columns(c, s)
    return c.select(common).union(s.select(common))


def _records(spark, d):
    """Event and header lines of all orders, in sixteen files."""
    text = lambda c: F.col(c).cast("string")
    lines = [
        F.concat_ws(" ", F.lit("E"), "o_orderkey", F.col("o_custkey") % 5, text("o_totalprice"), F.lit("0.25 0.5"), F.col("o_custkey") % 7, F.lit("-1 3 1 2 2"), F.col("o_custkey") % 11, F.lit("12 1"), text("o_totalprice")),
        F.concat_ws(" ", F.lit("N 2"), F.concat(F.lit('"w'), F.col("o_custkey") % 3, F.lit('"')), F.lit('"nominal"')),
        F.lit("U GEV MM"),
        F.concat_ws(" ", F.lit("C"), text("o_totalprice"), F.lit("0.5")),
    ]
    rows = table(spark, d, "orders").select(F.pmod("o_orderkey", F.lit(16)).cast("string").alias("file"), "o_orderkey", F.posexplode(F.array(*lines)).alias("n", "line"))
    return hepmc.from_lines(rows.select("file", (F.col("o_orderkey") * 8 + F.col("n")).alias("line_no"), "line"))


@query("s_hepmc_events", "SELECT o_orderkey AS event_id, CAST(o_custkey % 5 AS INTEGER) AS n_interactions, o_totalprice AS scale, 0.25e0 AS alpha_qcd, 0.5e0 AS alpha_qed, CAST(o_custkey % 7 AS INTEGER) AS process, 3 AS n_vertices, CAST(o_custkey % 11 + 12 AS BIGINT) AS random_sum, o_totalprice AS weight FROM orders")
def s_hepmc_events(spark, d):
    e = _records(spark, d)["events"]
    return e.select("event_id", "n_interactions", "scale", "alpha_qcd", "alpha_qed", "process", "n_vertices", (F.get("random_states", F.lit(0)) + F.get("random_states", F.lit(1))).alias("random_sum"), F.get("weights", F.lit(0)).alias("weight"))


@query("s_hepmc_headers", "SELECT o_orderkey AS event_id, concat('w', o_custkey % 3, '|nominal') AS weight_names, 'GEV' AS momentum_unit, 'MM' AS length_unit, o_totalprice AS cross_section, 0.5e0 AS cross_section_error FROM orders")
def s_hepmc_headers(spark, d):
    return hepmc.decode_headers(_records(spark, d)["headers"]).withColumn("weight_names", F.array_join("weight_names", "|"))


@query("s_hepmc_counts", "SELECT count(*) AS n_events, 0 AS n_particles, 0 AS n_vertices FROM orders")
def s_hepmc_counts(spark, d):
    return hepmc.counts(_records(spark, d))


@query("d_separations_rest", f"""WITH {PAIRS_SQL} SELECT event_id, i, j, round((abs(phi_a - phi_b) ** 3 + abs(ya - yb) ** 3) ** (1.0e0 / 3.0e0), 4) AS l3,
 CASE WHEN abs(phi_a + phi_b) + abs(ya + yb) > 1e-3 THEN round((abs(phi_a - phi_b) + abs(ya - yb)) / (abs(phi_a + phi_b) + abs(ya + yb)), 5) END AS braycurtis,
 round(coalesce(abs(phi_a - phi_b) / nullif(abs(phi_a) + abs(phi_b), 0), 0) + coalesce(abs(ya - yb) / nullif(abs(ya) + abs(yb), 0), 0), 7) AS canberra,
 round(1 - (phi_a * phi_b + ya * yb) / sqrt((phi_a ** 2 + ya ** 2) * (phi_b ** 2 + yb ** 2)), 4) + 0.0e0 AS cosine, 1.0e0 - sign((phi_a - ya) * (phi_b - yb)) AS correlation FROM pairs""")
def d_separations_rest(spark, d):
    """The quotient of nearly opposite points, which only shows rounding, is left out."""
    m = pairs.separations([F.col("phi_i"), F.col("rapidity_i")], [F.col("phi_j"), F.col("rapidity_j")])
    return pairs.pairs(inputs(spark, d)).select("event_id", "i", "j", r(m["l3"]).alias("l3"), F.when(F.abs(F.col("phi_i") + F.col("phi_j")) + F.abs(F.col("rapidity_i") + F.col("rapidity_j")) > 1e-3, r(m["braycurtis"], 5)).alias("braycurtis"), r(m["canberra"], 7).alias("canberra"), r(m["cosine"]).alias("cosine"), r(m["correlation"]).alias("correlation"))


@query("d_affinity_linear", f"WITH {PAIRS_SQL} SELECT event_id, i, j, round(max(sqrt(d2)) OVER (PARTITION BY event_id) - sqrt(d2), 4) + 0.0e0 AS linear FROM pairs")
def d_affinity_linear(spark, d):
    d2 = pairs.physical_distance2("angular")
    least = F.min(-F.sqrt(d2)).over(Window.partitionBy("event_id"))
    return pairs.pairs(inputs(spark, d)).select("event_id", "i", "j", r(pairs.affinity(d2, "linear", least=least)).alias("linear"))


@query("d_linked", f"WITH {PAIRS_SQL} SELECT event_id, count(*) AS n_pairs, count(*) FILTER (round(sqrt(d2), 9) <= 1.5) AS n_linked, round(1 - count(*) FILTER (round(sqrt(d2), 9) <= 1.5) / count(*), 5) AS sparsity FROM pairs GROUP BY event_id")
def d_linked(spark, d):
    p = pairs.pairs(inputs(spark, d)).select("event_id", F.round(F.sqrt(pairs.physical_distance2("angular")), 9).alias("d"))
    return pairs.linked(p, "d", 1.5).select("event_id", "n_pairs", "n_linked", r("sparsity", 5).alias("sparsity"))


@query("g_nearest_ancestor", f"""WITH {EDGES_SQL} SELECT 4000000000000 + o_orderkey AS start, 2000000000000 + c_nationkey AS node, 2 AS depth FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT child, 2000000000000 + c_nationkey, 3 FROM edges JOIN orders ON parent = 4000000000000 + o_orderkey JOIN customer ON c_custkey = o_custkey WHERE parent >= 4000000000000 AND parent < 5000000000000""")
def g_nearest_ancestor(spark, d):
    """The nation above each order and line item."""
    e = edges(spark, d)
    starts = e.where("child >= 4000000000000 and child < 6000000000000").select(F.col("child").alias("start"))
    nations = e.where("child >= 2000000000000 and child < 3000000000000").select(F.col("child").alias("node"))
    return graph.nearest_of_kind(starts, e, nations, [], keeper(spark)).select("start", "node", "depth")
