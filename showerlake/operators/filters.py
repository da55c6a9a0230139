"""Selections: observable and end-state particles, jet inputs, jet cuts, sanity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinematics as K


def observable() -> Column:
    return (F.col("track") >= 0) | (F.col("tower") >= 0)


def pt_eta(min_pt: float = 0.5, max_eta: float = 2.5) -> Column:
    return (F.col("pt") > min_pt) & (F.abs(K.pseudorapidity(K.theta(F.col("pt"), F.col("pz")))) < max_eta)


def end_state(particles: DataFrame, edges: DataFrame, key: str = "idx") -> DataFrame:
    """Rows without children."""
    return particles.join(edges.select("event_id", F.col("parent").alias(key)).distinct(), ["event_id", key], "left_anti")


def jet_inputs(particles: DataFrame, predicates: list[Column]) -> DataFrame:
    """Particles that pass all predicates, renumbered per event; the source index stays."""
    kept = particles
    for p in predicates:
        kept = kept.where(p)
    order = Window.partitionBy("event_id").orderBy("idx")
    return kept.select("event_id", (F.row_number().over(order) - 1).alias("input_idx"), F.col("idx").alias("source_idx"), "pt", "phi", F.col("rap").alias("rapidity"), "energy", "px", "py", "pz")


def jet_cut(jets: DataFrame, lead: float, other: float, min_tracks: int) -> DataFrame:
    """Jets above the cuts; an event whose leading jet fails has none at all."""
    w = Window.partitionBy("event_id")
    return jets.withColumn("lead_pt", F.max("pt").over(w)).where((F.col("lead_pt") > lead) & (F.col("pt") > other) & (F.col("n_tracks") >= min_tracks)).drop("lead_pt")


def tachyons(rows: DataFrame, relaxation: float) -> DataFrame:
    """Rows whose mass squared is below -relaxation."""
    m2 = K.mass2(F.col("energy"), F.col("px"), F.col("py"), F.col("pz"))
    return rows.withColumn("mass2", m2).where(m2 < -relaxation)


def uneven_events(*named: tuple[str, DataFrame]) -> DataFrame:
    """Number of events of each table against the largest."""
    out = None
    for name, df in named:
        one = df.agg(F.countDistinct("event_id").alias("n_events")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    everything = Window.partitionBy(F.lit(0))  # one row per table
    return out.withColumn("most", F.max("n_events").over(everything)).withColumn("even", F.col("n_events") == F.col("most"))


def cone_content(inputs: DataFrame, axes: DataFrame, delta_r: float) -> DataFrame:
    """Inputs of an event closer than delta_r to its axis."""
    a = axes.select("event_id", F.col("phi").alias("axis_phi"), F.col("rapidity").alias("axis_rapidity"))
    dphi = K.angular_distance(F.col("phi"), F.col("axis_phi"))
    dy = F.col("rapidity") - F.col("axis_rapidity")
    return inputs.join(a, "event_id").where(dphi * dphi + dy * dy < delta_r * delta_r)


def seeds(inputs: DataFrame, threshold: float) -> DataFrame:
    """Per event the input of most pt (ties: lowest index) if above the threshold."""
    best = inputs.groupBy("event_id").agg(F.max(F.struct("pt", (-F.col("input_idx")).alias("neg"), "input_idx", "phi", "rapidity")).alias("s"))
    return best.select("event_id", "s.input_idx", "s.pt", "s.phi", "s.rapidity").where(F.col("pt") > threshold)


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def without_empty_rows(df: DataFrame, scores: list[str]) -> DataFrame:
    """Rows with a finite score at least."""
    hit = F.lit(False)
    for s in scores:
        hit = hit | finite(F.col(s))
    return df.where(hit)


def without_empty_columns(df: DataFrame, scores: list[str]) -> DataFrame:
    """The table without those of the score columns that hold no finite value at all; one pass, one row to the driver."""
    found = df.agg(*(F.count(F.when(finite(F.col(s)), 1)).alias(s) for s in scores)).first()
    return df.drop(*(s for s in scores if not found[s]))


def matching(df: DataFrame, exact: dict, close: dict, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Rows equal to the `exact` values and near the `close` ones (|a - b| <= atol + rtol |b|)."""
    hit = F.lit(True)
    for name, value in exact.items():
        hit = hit & F.col(name).eqNullSafe(F.lit(value))
    for name, value in close.items():
        hit = hit & (F.abs(F.col(name) - value) <= atol + rtol * abs(value))
    return df.where(F.coalesce(hit, F.lit(False)))
