"""Queries of pairs, matching, masses, order and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinematics as K
from ..operators import clustering, joins, masses, pairs, ranking
from ..session import keeper
from ..sources.particles import PARTICLES_SQL as P
from ..sources.particles import ang_sql, particles, table
from .columns import INPUTS_SQL, inputs
from .registry import query, r

PAIRS_SQL = INPUTS_SQL + f""", pairs AS (
  SELECT a.event_id, a.input_idx AS i, b.input_idx AS j, (a.rapidity - b.rapidity) ** 2 + ({ang_sql('a.phi', 'b.phi')}) ** 2 AS d2,
    abs(a.rapidity - b.rapidity) + {ang_sql('a.phi', 'b.phi')} AS taxicab, a.px * b.px + a.py * b.py + a.pz * b.pz AS dot, a.energy AS ea, b.energy AS eb, a.pt AS pa, b.pt AS pb,
    a.phi AS phi_a, b.phi AS phi_b, a.rapidity AS ya, b.rapidity AS yb, a.px + b.px AS px, a.py + b.py AS py, a.pz + b.pz AS pz
  FROM inputs a JOIN inputs b ON a.event_id = b.event_id AND a.input_idx < b.input_idx
)"""


@query("d_closest_pair", f"""WITH {PAIRS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(sqrt(d2), 9), i, j) AS r FROM pairs)
SELECT event_id, i, j, round(sqrt(d2), 4) AS delta_r, round(sqrt(greatest((ea + eb) ** 2 - px ** 2 - py ** 2 - pz ** 2, 0)), 2) AS mass FROM ranked WHERE r = 1""")
def d_closest_pair(spark, d):
    """First step of sequential clustering: per event the closest pair and its joint mass."""
    p = pairs.pairs(inputs(spark, d))
    both = [F.col(f"{c}_i") + F.col(f"{c}_j") for c in ("energy", "px", "py", "pz")]
    near = p.select("event_id", F.struct(F.round(F.sqrt(pairs.physical_distance2("angular")), 9).alias("dr"), "i", "j", K.clipped_mass(*both).alias("mass")).alias("s"))
    best = near.groupBy("event_id").agg(F.min("s").alias("s"))
    return best.select("event_id", "s.i", "s.j", r(F.col("s.dr")).alias("delta_r"), r(F.col("s.mass"), 2).alias("mass"))


@query("d_distances", f"""WITH {PAIRS_SQL} SELECT event_id, i, j, round(d2, 4) AS angular, round(taxicab, 4) AS taxicab, round(1.0e0 - dot / (ea * eb), 4) + 0.0e0 AS normed, round(ea * eb - dot, 2) + 0.0e0 AS invarient,
 round(least(1 / (pa * pa), 1 / (pb * pb)), 6) AS antikt, round(pa * pb / (pa + pb), 6) AS luclus FROM pairs""")
def d_distances(spark, d):
    p = pairs.pairs(inputs(spark, d))
    kinds = {k: r(pairs.physical_distance2(k), 2 if k == "invarient" else 4).alias(k) for k in ("angular", "taxicab", "normed", "invarient")}
    return p.select("event_id", "i", "j", *kinds.values(), r(pairs.pt_factor(-1.0), 6).alias("antikt"), r(pairs.pt_factor(0.5, "Luclus"), 6).alias("luclus"))


@query("d_separations", f"""WITH {PAIRS_SQL} SELECT event_id, i, j, round(sqrt((phi_a - phi_b) ** 2 + (ya - yb) ** 2), 4) AS euclidean, round(abs(phi_a - phi_b) + abs(ya - yb), 4) AS taxicab,
 round(greatest(abs(phi_a - phi_b), abs(ya - yb)), 4) AS chebyshev, round(least(abs(phi_a - phi_b), abs(ya - yb)), 4) AS "min", round((abs(phi_a - phi_b) ** 4 + abs(ya - yb) ** 4) ** 0.25e0, 4) AS l4 FROM pairs""")
def d_separations(spark, d):
    m = pairs.separations([F.col("phi_i"), F.col("rapidity_i")], [F.col("phi_j"), F.col("rapidity_j")])
    return pairs.pairs(inputs(spark, d)).select("event_id", "i", "j", *(r(m[k]).alias(k) for k in ("euclidean", "taxicab", "chebyshev", "min", "l4")))


@query("d_affinity", f"WITH {PAIRS_SQL} SELECT event_id, i, j, round(exp(-d2 / 2), 5) AS exponent, round(CASE WHEN d2 > 0 THEN 1 / sqrt(d2) END, 3) AS inverse FROM pairs")
def d_affinity(spark, d):
    d2 = pairs.physical_distance2("angular")
    return pairs.pairs(inputs(spark, d)).select("event_id", "i", "j", r(pairs.affinity(d2, "exponent", 2.0, 2.0), 5).alias("exponent"), r(pairs.affinity(d2, "inverse"), 3).alias("inverse"))


@query("d_neighbours", f"""WITH {INPUTS_SQL}, d AS (SELECT a.event_id, a.input_idx AS i, b.input_idx AS j, round((a.rapidity - b.rapidity) ** 2 + ({ang_sql('a.phi', 'b.phi')}) ** 2, 9) AS d FROM inputs a JOIN inputs b ON a.event_id = b.event_id AND a.input_idx <> b.input_idx),
n AS (SELECT event_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY event_id, j ORDER BY d, i) AS r FROM d) WHERE r <= 2) SELECT event_id, i, j FROM n UNION SELECT event_id, j, i FROM n""")
def d_neighbours(spark, d):
    p = pairs.pairs(inputs(spark, d), columns=["pt", "phi", "rapidity", "px", "py", "pz", "energy"], ordered=True)
    return pairs.nearest_neighbours(p.select("event_id", "i", "j", F.round(pairs.physical_distance2("angular"), 9).alias("d")), 2)


@query("d_width", f"""WITH {P}, c AS (SELECT event_id, atan2(sum(sin(phi)), sum(cos(phi))) AS c FROM particles GROUP BY event_id),
w AS (SELECT p.event_id, idx, rap, (phi - c + 3.141592653589793e0) - 6.283185307179586e0 * floor((phi - c + 3.141592653589793e0) / 6.283185307179586e0) - 3.141592653589793e0 AS f FROM particles p JOIN c USING (event_id))
SELECT a.event_id, round(max(sqrt((a.rap - b.rap) ** 2 + (a.f - b.f) ** 2)), 4) AS width FROM w a JOIN w b ON a.event_id = b.event_id GROUP BY a.event_id""")
def d_width(spark, d):
    return pairs.widths(particles(spark, d), "rap", "phi", ["event_id"], order="idx").select("event_id", r("width").alias("width"))


@query("j_heritage", f"""WITH {P}, v AS (SELECT event_id, idx, idx // 2 AS s, idx + 1 AS e FROM particles),
p AS (SELECT me.event_id, me.idx, count(o.idx) AS n, CAST(coalesce(sum(o.idx), 0) AS BIGINT) AS s FROM v me LEFT JOIN v o ON o.event_id = me.event_id AND o.e = me.s AND o.idx <> me.idx GROUP BY ALL),
c AS (SELECT me.event_id, me.idx, count(o.idx) AS n, CAST(coalesce(sum(o.idx), 0) AS BIGINT) AS s FROM v me LEFT JOIN v o ON o.event_id = me.event_id AND o.s = me.e AND o.idx <> me.idx GROUP BY ALL)
SELECT p.event_id, p.idx, CAST(p.n AS INTEGER) AS n_parents, p.s AS parents, CAST(c.n AS INTEGER) AS n_children, c.s AS children FROM p JOIN c USING (event_id, idx)""")
def j_heritage(spark, d):
    v = particles(spark, d).select("event_id", "idx", F.floor(F.col("idx") / 2).cast("int").alias("start_vertex"), (F.col("idx") + 1).alias("end_vertex"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return joins.heritage(v).select("event_id", "idx", F.size("parents").alias("n_parents"), total("parents").alias("parents"), F.size("children").alias("n_children"), total("children").alias("children"))


@query("j_reverse", f"WITH {P} SELECT t.event_id, t.idx, coalesce(max(s.idx), -1) AS back FROM particles t LEFT JOIN particles s ON s.event_id = t.event_id AND s.track = t.idx GROUP BY ALL")
def j_reverse(spark, d):
    p = particles(spark, d).select("event_id", "idx", "track")
    return joins.reverse_references(p, p, "track", "idx")


@query("j_allocate", f"""WITH {P}, t AS (SELECT * FROM particles WHERE abs(mcpid) = 5), j AS (SELECT * FROM particles WHERE pt > 20),
n AS (SELECT t.event_id, t.idx AS tag_idx, j.idx AS jet_idx, (t.rap - j.rap) ** 2 + ({ang_sql('t.phi', 'j.phi')}) ** 2 AS d2 FROM t LEFT JOIN j USING (event_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id, tag_idx ORDER BY d2, jet_idx) AS r FROM n) SELECT event_id, tag_idx, CASE WHEN d2 <= 0.64e0 THEN jet_idx ELSE -1 END AS jet_idx FROM b WHERE r = 1""")
def j_allocate(spark, d):
    p = particles(spark, d).withColumnRenamed("rap", "rapidity")
    return joins.allocate(p.where("abs(mcpid) = 5").withColumnRenamed("idx", "tag_idx"), p.where("pt > 20").withColumnRenamed("idx", "jet_idx"), 0.64)


@query("j_marry", f"WITH {P} SELECT event_id, idx, mcpid, supp, true AS married FROM particles")
def j_marry(spark, d):
    p = particles(spark, d)
    return joins.marry(p.select("event_id", "idx", "mcpid", "px", "energy"), p, ["mcpid"], ["px", "energy"], ["supp"]).select("event_id", "idx", "mcpid", "supp", "married")


@query("j_match_events", """WITH l AS (SELECT o_orderkey // 32 AS event_n, o_orderkey AS row, o_custkey % 3 AS k, o_totalprice AS x FROM orders WHERE o_orderkey % 2 = 0), rr AS (SELECT o_orderkey // 32 AS event_n, o_orderkey AS row, o_custkey % 3 AS k, o_totalprice AS x FROM orders WHERE o_orderkey % 2 = 1),
n AS (SELECT l.row, rr.row AS row_right, abs(l.x - rr.x) AS d FROM l JOIN rr ON l.event_n = rr.event_n AND l.k = rr.k),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, row_right) AS a, row_number() OVER (PARTITION BY row_right ORDER BY d, row) AS c FROM n) WHERE a = 1 AND c = 1)
SELECT l.row AS row_left, coalesce(b.row_right, -1) AS row_right FROM l LEFT JOIN b USING (row)""")
def j_match_events(spark, d):
    return joins.match_events(*_two_datasets(spark, d), ["k"], ["x"])


def _two_datasets(spark, d):
    """The even and the odd orders, which are all; 32 keys in a row are an event."""
    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 32).alias("event_n"), F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 3).alias("k"), F.col("o_totalprice").alias("x"))
    return o.where("row % 2 = 0"), o.where("row % 2 = 1")


@query("j_match_greedy")
def j_match_greedy(spark, d):
    return joins.match_greedily(*_two_datasets(spark, d), ["k"], ["x"], keeper(spark))


@query("j_pile_up", f"""WITH {P}, m AS (SELECT event_id, idx, pt FROM particles WHERE part % 2 = 0), s AS (SELECT event_id, idx, pt FROM particles WHERE part % 2 = 1), t AS (SELECT event_id, max(idx) + 1 AS shift FROM m GROUP BY event_id)
SELECT event_id, idx, pt FROM m UNION ALL SELECT s.event_id, CAST(s.idx + coalesce(shift, 0) AS INTEGER), pt FROM s LEFT JOIN t USING (event_id)""")
def j_pile_up(spark, d):
    p = particles(spark, d).select("event_id", "idx", "pt", "part")
    return joins.pile_up(p.where("part % 2 = 0"), p.where("part % 2 = 1")).select("event_id", "idx", "pt")


TOP_SQL = P + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pt DESC, idx) AS r FROM particles) WHERE r <= 4),
pm AS (SELECT a.event_id, CAST(a.r AS INTEGER) AS r1, CAST(b.r AS INTEGER) AS r2, sqrt(greatest((a.energy + b.energy) ** 2 - (a.px + b.px) ** 2 - (a.py + b.py) ** 2 - (a.pz + b.pz) ** 2, 0)) AS mass FROM top a JOIN top b ON a.event_id = b.event_id AND a.r < b.r)"""


@query("a_all_masses", f"""WITH {P}, m AS (SELECT event_id, sqrt(greatest(sum(energy) ** 2 - sum(px) ** 2 - sum(py) ** 2 - sum(pz) ** 2, 0)) AS mass FROM particles WHERE pt > 10 GROUP BY event_id HAVING count(*) > 1)
SELECT o_orderkey AS event_id, round(coalesce(mass, 0), 2) AS mass FROM orders LEFT JOIN m ON event_id = o_orderkey""")
def a_all_masses(spark, d):
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    hard = particles(spark, d).where("pt > 10")
    several = hard.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id")
    return masses.all_masses(events, hard.join(several, "event_id", "left_semi")).select("event_id", r("mass", 2).alias("mass"))


@query("a_pt_pairs", f"WITH {TOP_SQL} SELECT event_id, r1, r2, round(mass, 2) AS mass FROM pm")
def a_pt_pairs(spark, d):
    return masses.pt_pairs(particles(spark, d)).select("event_id", "r1", "r2", r("mass", 2).alias("mass"))


@query("a_best_mass")
def a_best_mass(spark, d):
    """SQL for it did not end in time on whole tables; tests/test_whole_tables.py has the brute-force version."""
    return masses.best_pair(masses.pt_pairs(particles(spark, d)), 40.0).select("event_id", "r1", "r2", r("mass", 2).alias("mass"), r("second", 2).alias("second"))


@query("a_smallest_angle", f"""WITH {P}, n AS (SELECT a.event_id, a.idx AS i, b.idx AS j, round(sqrt((a.phi - b.phi) ** 2 + (a.rap - b.rap) ** 2), 9) AS d FROM particles a JOIN particles b ON a.event_id = b.event_id AND a.idx < b.idx)
SELECT event_id, i, j, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, i, j) AS k FROM n) WHERE k = 1""")
def a_smallest_angle(spark, d):
    return masses.smallest_angle(particles(spark, d)).select("event_id", "i", "j", r("distance").alias("distance"))


@query("a_background_mass", f"WITH {P} SELECT event_id, round(sqrt(greatest(sum(energy) ** 2 - sum(px) ** 2 - sum(py) ** 2 - sum(pz) ** 2, 0)), 1) AS mass FROM particles WHERE abs(mcpid) <> 5 GROUP BY event_id HAVING count(*) > 1")
def a_background_mass(spark, d):
    bg = particles(spark, d).where("abs(mcpid) <> 5")
    n = bg.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id")
    return masses.group_mass(bg.join(n, "event_id", "left_semi"), ["event_id"]).select("event_id", r("mass", 1).alias("mass"))


@query("a_scores", """SELECT o_orderpriority AS jet_name, round(avg(CASE WHEN o_custkey % 10 <> 0 THEN o_totalprice END), 3) AS avg_score, round(avg(CASE WHEN o_custkey % 10 <> 0 AND o_orderkey % 2 = 0 THEN o_totalprice END), 3) AS masked_score FROM orders GROUP BY 1""")
def a_scores(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("jet_name"), F.when(F.col("o_custkey") % 10 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("score"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    return masses.scores(o, ["jet_name"], ["score"], "even").select("jet_name", r("avg_score", 3).alias("avg_score"), r("masked_score", 3).alias("masked_score"))


@query("a_best_setting", "SELECT c_nationkey AS class, c_name AS name, c_acctbal AS score FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS r FROM customer) WHERE r = 1")
def a_best_setting(spark, d):
    t = table(spark, d, "customer").select(F.col("c_nationkey").alias("class"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    return masses.best_setting(t, "name", "score", ["class"])


@query("a_tabulate", """SELECT l_returnflag AS jet_name, max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS F, max(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS O FROM lineitem GROUP BY 1""")
def a_tabulate(spark, d):
    params = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("jet_name"), F.col("l_linestatus").alias("param")).agg(F.max("l_quantity").alias("value"))
    return masses.tabulate(params).select("jet_name", "F", "O")


@query("t_mass_share", f"""WITH {P}, l AS (SELECT event_id, track AS tag, tower AS jet, energy, px, py, pz FROM particles WHERE track >= 0 AND tower >= 0),
m AS (SELECT event_id, tag, jet, sum(energy) ** 2 - sum(px) ** 2 - sum(py) ** 2 - sum(pz) ** 2 AS mass2 FROM l GROUP BY ALL HAVING count(*) > 1)
SELECT event_id, tag, jet, round(mass2, 1) AS mass2, row_number() OVER (PARTITION BY event_id, tag ORDER BY round(mass2, 6) DESC, jet) = 1 AS is_best FROM m""")
def t_mass_share(spark, d):
    links = particles(spark, d).where("track >= 0 and tower >= 0").select("event_id", F.col("track").alias("tag"), F.col("tower").alias("jet"), "energy", "px", "py", "pz")
    several = links.groupBy("event_id", "tag", "jet").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return masses.share_of_mass(links.join(several, ["event_id", "tag", "jet"], "left_semi")).select("event_id", "tag", "jet", r("mass2", 1).alias("mass2"), "is_best")


@query("w_order", f"WITH {P} SELECT event_id, idx, row_number() OVER (PARTITION BY event_id ORDER BY pt, idx) - 1 AS place FROM particles")
def w_order(spark, d):
    return ranking.ordered(particles(spark, d), "pt").select("event_id", "idx", F.col("place").cast("long").alias("place"))


MASS_SQL = "m AS (SELECT o_orderpriority AS g, o_orderkey AS event_id, o_totalprice AS mass FROM orders)"


def _masses(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("mass"))


@query("w_quality_width", f"""WITH {MASS_SQL}, n AS (SELECT g, count(*) AS n, greatest(2, least(CAST(ceil(count(*) * 0.4e0) AS BIGINT), count(*))) AS t FROM m GROUP BY g), o AS (SELECT g, mass, row_number() OVER (PARTITION BY g ORDER BY mass, event_id) AS r FROM m)
SELECT n.g, round(min(b.mass - a.mass) / max(n.n), 5) AS width_per_event FROM n JOIN o a ON a.g = n.g JOIN o b ON b.g = n.g AND b.r = a.r + n.t - 1 GROUP BY n.g""")
def w_quality_width(spark, d):
    return ranking.quality_width(_masses(spark, d), "g", 0.4).select("g", r("width_per_event", 5).alias("width_per_event"))


@query("w_quality_fraction", f"""WITH {MASS_SQL}, w AS (SELECT g, count(*) OVER (PARTITION BY g ORDER BY mass RANGE BETWEEN CURRENT ROW AND 20000.0e0 FOLLOWING) - count(*) OVER (PARTITION BY g ORDER BY mass RANGE BETWEEN 20000.0e0 FOLLOWING AND 20000.0e0 FOLLOWING) AS k FROM m)
SELECT g, round(count(*) / CAST(max(k) AS DOUBLE), 5) AS events_per_window FROM w GROUP BY g""")
def w_quality_fraction(spark, d):
    return ranking.quality_fraction(_masses(spark, d), "g", 40000.0, 0.5).select("g", r("events_per_window", 5).alias("events_per_window"))


@query("w_gap_groups", f"""WITH {P}, j AS (SELECT *, CASE WHEN rap - lag(rap) OVER (PARTITION BY event_id ORDER BY rap, idx) > 0.5e0 THEN 1 ELSE 0 END AS x FROM particles)
SELECT event_id, idx, CAST(sum(x) OVER (PARTITION BY event_id ORDER BY rap, idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gap_group FROM j""")
def w_gap_groups(spark, d):
    return ranking.gap_groups(particles(spark, d), ["event_id"], "rap", 0.5).select("event_id", "idx", "gap_group")


@query("w_most_common", f"WITH {P} SELECT mcpid, count(*) AS n FROM particles GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def w_most_common(spark, d):
    return ranking.most_common(particles(spark, d), "mcpid", 7)


@query("c_antikt_jets")
def c_antikt_jets(spark, d):
    """Anti-kt pseudojet trees of every event."""
    return clustering.generalised_kt(inputs(spark, d), 0.8, -1.0)


@query("c_kt_filtered_jets")
def c_kt_filtered_jets(spark, d):
    return clustering.filter_jets(clustering.generalised_kt(inputs(spark, d), 0.8, 1.0), 30.0, 15.0, 2)


@query("c_cambridge_luclus")
def c_cambridge_luclus(spark, d):
    return clustering.generalised_kt(inputs(spark, d), 0.8, 0.5, "normed", "Luclus")


@query("c_pairs_only", f"""WITH {INPUTS_SQL}, two AS (SELECT event_id FROM inputs GROUP BY event_id HAVING count(*) = 2), x AS (SELECT two.event_id, a.pt AS pa, b.pt AS pb, (a.rapidity - b.rapidity) ** 2 + ({ang_sql('a.phi', 'b.phi')}) ** 2 AS d2
 FROM inputs a JOIN inputs b ON a.event_id = b.event_id AND a.input_idx = 0 AND b.input_idx = 1 JOIN two ON two.event_id = a.event_id) SELECT event_id, CASE WHEN d2 < 0.64e0 THEN 1 ELSE 2 END AS n_jets FROM x""")
def c_pairs_only(spark, d):
    """Events of two inputs: one jet if they are closer than the radius, else two."""
    i = inputs(spark, d)
    two = i.groupBy("event_id").agg(F.count("*").alias("n")).where("n = 2").select("event_id")
    trees = clustering.generalised_kt(i.join(two, "event_id", "left_semi"), 0.8, -1.0, closer2=0.64)
    return trees.groupBy("event_id").agg(F.countDistinct("jet").cast("int").alias("n_jets"))


@query("c_cone")
def c_cone(spark, d):
    return clustering.labelled(inputs(spark, d), "iterative_cone", delta_r=0.8, seed=5.0)


@query("c_spectral")
def c_spectral(spark, d):
    return clustering.labelled(inputs(spark, d), "spectral", delta_r=0.6)


@query("c_spectral_conductance")
def c_spectral_conductance(spark, d):
    return clustering.labelled(inputs(spark, d), "spectral", stop="conductance")


@query("c_spectral_beam")
def c_spectral_beam(spark, d):
    return clustering.labelled(inputs(spark, d), "spectral", stop="beamparticle", eigen="abscos")


@query("c_spectral_full")
def c_spectral_full(spark, d):
    return clustering.labelled(inputs(spark, d), "spectral", delta_r=0.6, refresh=True, neighbours=3)


@query("c_indicator")
def c_indicator(spark, d):
    return clustering.labelled(inputs(spark, d), "indicator")


@query("c_splitting")
def c_splitting(spark, d):
    return clustering.labelled(inputs(spark, d), "splitting")


@query("c_spectral_kmeans")
def c_spectral_kmeans(spark, d):
    return clustering.labelled(inputs(spark, d), "spectral_kmeans", clusters=2)


@query("b_scan")
def b_scan(spark, d):
    """Jets per event for a grid of radii and exponents, the first setting being done already."""
    grid = [{"delta_r": dr, "power": p} for dr in (0.4, 0.8) for p in (-1.0, 0.0, 1.0)]
    return clustering.scan(inputs(spark, d), grid, done=[0]).groupBy("setting", "event_id").agg(F.countDistinct("jet").alias("n_jets"))


@query("l_shapes")
def l_shapes(spark, d):
    return clustering.shapes(inputs(spark, d))
