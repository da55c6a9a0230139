"""Events, particles, jet inputs and the shower graph, read from the star-schema tables.

An order is an event and its line items are the particles, in one fixed total order; momenta follow from
quantity and keys such that the rapidity can be computed back. The foreign keys are the shower graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586
PI = 3.141592653589793


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, idx, mcpid, pt, phi, rap, px, py, pz, energy, m, track, tower, supp, part); one shuffle by event.

    Operators that group by event_id reuse this partitioning.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    base = rows.select(
        F.col("l_orderkey").alias("event_id"),
        (F.row_number().over(order) - 1).alias("idx"),
        (F.pmod("l_partkey", F.lit(11)) - 5).cast("int").alias("mcpid"),
        F.col("l_quantity").alias("pt"),
        (F.lit(TWO_PI) * F.pmod(F.col("l_partkey") * 17 + F.col("l_suppkey") * 13, F.lit(997)) / F.lit(997.0) - PI).alias("phi"),
        (F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey") * 7, F.lit(101)) / F.lit(100.0) * 5.0 - 2.5).alias("rap"),
        (F.col("l_discount") + 0.0).alias("m"),
        F.when(F.pmod("l_partkey", F.lit(3)) == 0, -1).otherwise(F.pmod("l_partkey", F.lit(7))).cast("int").alias("track"),
        F.when(F.pmod("l_suppkey", F.lit(2)) == 0, -1).otherwise(F.pmod("l_suppkey", F.lit(5))).cast("int").alias("tower"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_partkey").alias("part"),
    )
    mt = F.sqrt(F.col("pt") * F.col("pt") + F.col("m") * F.col("m"))
    return base.select(
        "*", (F.col("pt") * F.cos("phi")).alias("px"), (F.col("pt") * F.sin("phi")).alias("py"), (mt * F.sinh("rap")).alias("pz"), (mt * F.cosh("rap")).alias("energy")
    )


#: The same for DuckDB, as common table expressions.
PARTICLES_SQL = """base AS (
  SELECT l_orderkey AS event_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INTEGER) AS idx,
    CAST(l_partkey % 11 - 5 AS INTEGER) AS mcpid, l_quantity AS pt,
    6.283185307179586e0 * ((l_partkey * 17 + l_suppkey * 13) % 997) / 997.0e0 - 3.141592653589793e0 AS phi,
    ((l_partkey * 31 + l_suppkey * 7) % 101) / 100.0e0 * 5.0e0 - 2.5e0 AS rap,
    l_discount + 0.0e0 AS m,
    CAST(CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE l_partkey % 7 END AS INTEGER) AS track,
    CAST(CASE WHEN l_suppkey % 2 = 0 THEN -1 ELSE l_suppkey % 5 END AS INTEGER) AS tower,
    l_suppkey AS supp, l_partkey AS part
  FROM lineitem
), particles AS (
  SELECT *, pt * cos(phi) AS px, pt * sin(phi) AS py, sqrt(pt * pt + m * m) * sinh(rap) AS pz, sqrt(pt * pt + m * m) * cosh(rap) AS energy FROM base
)"""

#: DuckDB macros as text: cyclic distance of two angles.
def ang_sql(a: str, b: str) -> str:
    r = f"(({a}) - ({b}))"
    t = "6.283185307179586e0"
    return f"least({r} - {t} * floor({r} / {t}), -{r} - {t} * floor(-{r} / {t}))"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child) of the shower graph: region, nation, customer and supplier, order, line item.

    Ids are disjoint ranges: kind * 10^12 + key, for line items 5 * 10^12 + event_id * 100 + idx.
    """
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, key: F.lit(kind * 10**12) + F.col(key).cast("long")
    parts = particles(spark, sf_dir).select(node(4, "event_id").alias("parent"), (F.lit(5 * 10**12) + F.col("event_id") * 100 + F.col("idx")).alias("child"))
    return (
        t("nation").select(node(1, "n_regionkey").alias("parent"), node(2, "n_nationkey").alias("child"))
        .union(t("customer").select(node(2, "c_nationkey"), node(3, "c_custkey")))
        .union(t("supplier").select(node(2, "s_nationkey"), node(6, "s_suppkey")))
        .union(t("orders").select(node(3, "o_custkey"), node(4, "o_orderkey")))
        .union(parts)
    )


EDGES_SQL = PARTICLES_SQL + """, edges AS (
  SELECT 1000000000000 + n_regionkey AS parent, 2000000000000 + n_nationkey AS child FROM nation
  UNION ALL SELECT 2000000000000 + c_nationkey, 3000000000000 + c_custkey FROM customer
  UNION ALL SELECT 2000000000000 + s_nationkey, 6000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 3000000000000 + o_custkey, 4000000000000 + o_orderkey FROM orders
  UNION ALL SELECT 4000000000000 + event_id, 5000000000000 + event_id * 100 + idx FROM particles
)"""
