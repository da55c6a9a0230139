"""Queries of the shower graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, joins
from ..session import keeper
from ..sources.particles import EDGES_SQL, edges, particles, table
from ..sources.particles import PARTICLES_SQL as P
from .registry import query, r

WALK_SQL = EDGES_SQL + """, walk AS (
  SELECT s.start, s.start AS node, 0 AS depth FROM (SELECT 2000000000000 + n_nationkey AS start FROM nation) s
  UNION ALL SELECT w.start, e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node
)"""


def _graph(spark, d):
    """All nations as starts, and the whole graph; it is one, so the walks have no keys."""
    return table(spark, d, "nation").select((F.lit(2 * 10**12) + F.col("n_nationkey").cast("long")).alias("start")), edges(spark, d)


@query("g_leaves", f"WITH RECURSIVE {WALK_SQL} SELECT DISTINCT start, node FROM walk WHERE node NOT IN (SELECT parent FROM edges)")
def g_leaves(spark, d):
    starts, e = _graph(spark, d)
    return graph.leaves(graph.walk(starts, e, [], keeper(spark)), e, []).select("start", "node")


@query("g_ranks", f"""WITH RECURSIVE {WALK_SQL}, l AS (SELECT node, max(depth) AS depth FROM walk GROUP BY node)
SELECT node, CASE WHEN node IN (SELECT parent FROM edges) THEN depth ELSE max(depth) OVER () END AS rank FROM l""")
def g_ranks(spark, d):
    starts, e = _graph(spark, d)
    return graph.ranks(graph.walk(starts, e, [], keeper(spark)), e, []).select("node", "rank")


@query("g_roots", f"WITH {EDGES_SQL}, n AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges) SELECT node FROM n WHERE node NOT IN (SELECT child FROM edges)")
def g_roots(spark, d):
    e = _graph(spark, d)[1]
    nodes = e.select(F.col("parent").alias("node")).union(e.select("child")).distinct()
    return graph.roots(nodes, e, []).select("node")


@query("g_upper_layers", f"WITH RECURSIVE {WALK_SQL} SELECT start, node, min(depth) AS depth FROM walk WHERE depth <= 1 GROUP BY ALL")
def g_upper_layers(spark, d):
    starts, e = _graph(spark, d)
    return graph.descendants(starts, e, 1, []).groupBy("start", "node").agg(F.min("depth").alias("depth"))


CHAIN_SQL = P + ", e AS (SELECT event_id, idx AS parent, idx + 1 AS child FROM particles WHERE (event_id, idx + 1) IN (SELECT (event_id, idx) FROM particles))"


def _chain(spark, d):
    p = particles(spark, d).select("event_id", F.col("idx").alias("node"), F.abs("mcpid").alias("kind"), "mcpid")
    e = p.select("event_id", (F.col("node") - 1).alias("parent"), F.col("node").alias("child")).where("parent >= 0")
    return p, e


@query("g_last_b", f"""WITH {CHAIN_SQL} SELECT p.event_id, p.idx AS node FROM particles p WHERE abs(mcpid) = 5 AND NOT EXISTS (SELECT 1 FROM particles c WHERE c.event_id = p.event_id AND c.idx = p.idx + 1 AND abs(c.mcpid) = 5)""")
def g_last_b(spark, d):
    p, e = _chain(spark, d)
    return graph.last_of_kind(p.where("kind = 5"), e, "kind").select("event_id", "node")


@query("g_last_instance", f"""WITH RECURSIVE {CHAIN_SQL}, k AS (SELECT event_id, idx, sign(mcpid) AS s FROM particles), w AS (SELECT event_id, idx AS node, idx AS last, s FROM k
 UNION ALL SELECT w.event_id, w.node, k.idx, w.s FROM w JOIN k ON k.event_id = w.event_id AND k.idx = w.last + 1 AND k.s = w.s) SELECT event_id, node, max(last) AS last FROM w GROUP BY ALL""")
def g_last_instance(spark, d):
    p, e = _chain(spark, d)
    return graph.last_instance(p.withColumn("kind", F.signum("mcpid")), e, "kind", 5).select("event_id", "node", "last")


@query("g_shared_ends", """WITH e AS (SELECT DISTINCT l_suppkey % 40 AS start, l_partkey AS node FROM lineitem) SELECT a.start % 4 AS kind_a, b.start % 4 AS kind_b, count(*) AS n FROM e a JOIN e b ON a.node = b.node AND a.start <> b.start GROUP BY ALL""")
def g_shared_ends(spark, d):
    ends = table(spark, d, "lineitem").select(F.lit(0).alias("event_id"), (F.col("l_suppkey") % 40).alias("start"), F.col("l_partkey").alias("node")).distinct()
    kinds = ends.select("event_id", F.col("start").alias("node"), (F.col("start") % 4).alias("kind")).distinct()
    return graph.shared_ends(ends, kinds)


@query("g_hops", f"WITH {P} SELECT a.event_id, a.idx AS start, b.idx AS node, abs(a.idx - b.idx) AS hops FROM particles a JOIN particles b ON a.event_id = b.event_id AND abs(a.idx - b.idx) <= 3")
def g_hops(spark, d):
    p, e = _chain(spark, d)
    return graph.hop_distance(p.select("event_id", "node"), e, 3)


@query("j_vertex_truth", f"""WITH {P} SELECT a.event_id, a.idx, coalesce(b.idx, -1) AS ends_at, round(coalesce(b.pt - a.pt, 0), 4) + 0.0e0 AS step FROM particles a LEFT JOIN particles b ON a.event_id = b.event_id AND b.idx = a.idx + 1""")
def j_vertex_truth(spark, d):
    p = particles(spark, d)
    after = p.select("event_id", (F.col("idx") - 1).alias("idx"), F.col("idx").alias("ends_at"), F.col("pt").alias("far"))
    return p.join(after, ["event_id", "idx"], "left").select("event_id", "idx", F.coalesce("ends_at", F.lit(-1)).alias("ends_at"), r(F.coalesce(F.col("far") - F.col("pt"), F.lit(0.0))).alias("step"))
