"""Masses of particle groups, scores over events, best settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinematics as K
from .filters import finite
from .ranges import running_sums

MOMENTA = ["energy", "px", "py", "pz"]


def group_mass(rows: DataFrame, keys: list[str], clip: bool = True) -> DataFrame:
    """(keys, mass) of summed four-momenta."""
    sums = rows.groupBy(*keys).agg(*(F.sum(c).alias(f"s_{c}") for c in MOMENTA))
    parts = [F.col(f"s_{c}") for c in MOMENTA]
    return sums.select(*keys, (K.clipped_mass(*parts) if clip else K.mass(*parts)).alias("mass"))


def all_masses(events: DataFrame, jets: DataFrame) -> DataFrame:
    """Mass of all jets of every event; 0 without jets."""
    return events.select("event_id").join(group_mass(jets, ["event_id"]), "event_id", "left").select("event_id", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def leading(jets: DataFrame, n: int) -> DataFrame:
    """The n jets of most pt per event with their place r (ties: lower index first)."""
    w = Window.partitionBy("event_id").orderBy(F.desc("pt"), "idx")
    return jets.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


def pair_mass() -> Column:
    """Mass of the pair (a_*, b_*)."""
    return K.clipped_mass(*(F.col(f"a_{c}") + F.col(f"b_{c}") for c in MOMENTA))


def pt_pairs(jets: DataFrame, n: int = 4) -> DataFrame:
    """(event_id, r1, r2, mass) of the pairs of the n leading jets."""
    top = leading(jets, n)
    a = top.select("event_id", F.col("r").alias("r1"), *(F.col(c).alias(f"a_{c}") for c in MOMENTA))
    b = top.select("event_id", F.col("r").alias("r2"), *(F.col(c).alias(f"b_{c}") for c in MOMENTA))
    return a.join(b, "event_id").where("r1 < r2").select("event_id", "r1", "r2", pair_mass().alias("mass"))


def best_pair(pairs: DataFrame, target: float) -> DataFrame:
    """Pair nearest the target mass, and the complementary one of four if there is one (else mass 0)."""
    best = pairs.groupBy("event_id").agg(F.min(F.struct(F.round(F.abs(F.col("mass") - target), 9).alias("gap"), "r1", "r2", "mass")).alias("b"))
    other = pairs.select("event_id", F.col("r1").alias("o1"), F.col("r2").alias("o2"), F.col("mass").alias("other"))
    joined = best.join(other, "event_id", "left").where("o1 is null or (o1 not in (b.r1, b.r2) and o2 not in (b.r1, b.r2)) or (o1 = b.r1 and o2 = b.r2)")
    found = joined.groupBy("event_id", "b").agg(F.max(F.when(~((F.col("o1") == F.col("b.r1")) & (F.col("o2") == F.col("b.r2"))), F.col("other"))).alias("second"))
    return found.select("event_id", F.col("b.r1").alias("r1"), F.col("b.r2").alias("r2"), F.col("b.mass").alias("mass"), F.coalesce("second", F.lit(0.0)).alias("second"))


def smallest_angle(jets: DataFrame) -> DataFrame:
    """(event_id, i, j, distance): closest pair of an event on raw angle and rapidity (no wrap)."""
    a = jets.select("event_id", F.col("idx").alias("i"), F.col("phi").alias("pa"), F.col("rap").alias("ya"))
    b = jets.select("event_id", F.col("idx").alias("j"), F.col("phi").alias("pb"), F.col("rap").alias("yb"))
    d = F.sqrt((F.col("pa") - F.col("pb")) * (F.col("pa") - F.col("pb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb")))
    near = a.join(b, "event_id").where("i < j").groupBy("event_id").agg(F.min(F.struct(F.round(d, 9).alias("d"), "i", "j")).alias("b"))
    return near.select("event_id", "b.i", "b.j", F.col("b.d").alias("distance"))


def scores(rows: DataFrame, keys: list[str], columns: list[str], mask: str) -> DataFrame:
    """Means of the finite values of each column, and again over masked rows only; null without any."""
    out = []
    for c in columns:
        ok = finite(F.col(c))
        out += [F.avg(F.when(ok, F.col(c))).alias(f"avg_{c}"), F.avg(F.when(ok & F.col(mask), F.col(c))).alias(f"masked_{c}")]
    return rows.groupBy(*keys).agg(*out)


def best_setting(table: DataFrame, name: str, score: str, by: list[str] | None = None) -> DataFrame:
    """The setting of the highest finite score (ties: first name); without any finite score the first name."""
    ok = F.when(finite(F.col(score)), F.col(score))
    w = Window.partitionBy(*(by or [])).orderBy(ok.desc_nulls_last(), name)
    return table.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def tabulate(params: DataFrame, key: str = "jet_name") -> DataFrame:
    """One row per setting, one column per parameter."""
    return params.groupBy(key).pivot("param").agg(F.first("value"))


def share_of_mass(links: DataFrame) -> DataFrame:
    """(event_id, tag, jet, mass2, is_best) from rows (event_id, tag, jet, momenta) of shared inputs."""
    sums = links.groupBy("event_id", "tag", "jet").agg(*(F.sum(c).alias(c) for c in MOMENTA))
    with_mass = sums.select("event_id", "tag", "jet", K.mass2(*(F.col(c) for c in MOMENTA)).alias("mass2"))
    w = Window.partitionBy("event_id", "tag").orderBy(F.round("mass2", 6).desc(), "jet")
    return with_mass.withColumn("is_best", F.row_number().over(w) == 1)


def combined_mass(events: DataFrame, members: DataFrame, tag_leaves: DataFrame, part: str = "both") -> DataFrame:
    """(event_id, mass) of the chosen jets' inputs: all of them, those that are leaves of a tag (signal), or the others (background).

    `members` has event_id, leaf and momenta, `tag_leaves` event_id and leaf; negative squares count as zero, and
    an event without any member has mass zero.
    """
    if part not in ("both", "signal", "background"):
        raise ValueError(f"no such part of a jet: {part}")
    chosen = members
    if part != "both":
        chosen = members.join(tag_leaves.select("event_id", "leaf").distinct(), ["event_id", "leaf"], "left_semi" if part == "signal" else "left_anti")
    return all_masses(events, chosen)


def sorted_masses(masses: DataFrame, least: float = 1e-5) -> DataFrame:
    """(event_id, mass, place) of masses above `least` in ascending order (ties: lower event), over all events."""
    kept = masses.where(F.col("mass") > least).select("event_id", "mass", F.lit(1).alias("one"))
    return running_sums(kept, [], ["mass", "event_id"], {"upto": "one"}).select("event_id", "mass", (F.col("upto") - 1).alias("place"))


def leading_pair(pairs: DataFrame) -> DataFrame:
    """(event_id, mass) of the pair of the two leading jets."""
    return pairs.where("r1 = 1 and r2 = 2").select("event_id", "mass")
