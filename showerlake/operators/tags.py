"""Truth tags: which particles tag, what of them is detectable, and which jets they go to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinematics as K
from .clustering import per_group
from .graph import descendants_until_done

MOMENTA = ["energy", "px", "py", "pz"]


def tag_particles(nodes: DataFrame, edges: DataFrame, is_tag: Column, is_hard: Column, keep) -> DataFrame:
    """(event_id, node): last tags of the chains that start at a root or below a hard particle.

    `nodes` has event_id, node and what the predicates read; `keep` stores the levels of the walk.
    """
    tags = nodes.where(is_tag).select("event_id", "node")
    child = edges.select("event_id", F.col("child").alias("node"), "parent")
    hard = nodes.where(is_hard).select("event_id", F.col("node").alias("parent"))
    starts = tags.join(child, ["event_id", "node"], "left_anti").union(tags.join(child.join(hard, ["event_id", "parent"], "left_semi").select("event_id", "node"), ["event_id", "node"], "left_semi")).distinct()
    inner = keep(edges.join(tags.withColumnRenamed("node", "parent"), ["event_id", "parent"], "left_semi").join(tags.withColumnRenamed("node", "child"), ["event_id", "child"], "left_semi").select("event_id", "parent", "child"))
    reached = descendants_until_done(starts.withColumnRenamed("node", "start"), inner, ["event_id"], keep).select("event_id", "node").distinct()
    return reached.join(inner.select("event_id", F.col("parent").alias("node")).distinct(), ["event_id", "node"], "left_anti")


def detectable(leaves: DataFrame, inputs: DataFrame) -> DataFrame:
    """(event_id, tag, momenta, n) summed over the leaves of each tag that are inputs; tags without any are left out."""
    seen = leaves.join(inputs.select("event_id", F.col("idx").alias("leaf"), *MOMENTA), ["event_id", "leaf"])
    return seen.groupBy("event_id", "tag").agg(*(F.sum(c).alias(c) for c in MOMENTA), F.count("*").alias("n"))


def tag_groups(leaves: DataFrame) -> DataFrame:
    """(event_id, seed, tag): each tag not yet grouped seeds a group of all tags that share a leaf with it.

    Sharing is with the seed alone, so it is not passed on, and a grouped tag can be picked again.
    """

    def kernel(e: dict) -> dict:
        owned: dict[int, set] = {}
        for t, leaf in zip(e["tag"].tolist(), e["leaf"].tolist(), strict=True):
            owned.setdefault(t, set()).add(leaf)
        done, seeds, members = set(), [], []
        for seed in sorted(owned):
            if seed not in done:
                group = [t for t in sorted(owned) if owned[t] & owned[seed]]
                done |= set(group)
                seeds += [seed] * len(group)
                members += group
        return {"event_id": np.full(len(seeds), e["event_id"][0]), "seed": np.array(seeds), "tag": np.array(members)}

    return per_group(leaves, ["event_id"], ["tag", "leaf"], ["tag", "leaf"], kernel, "event_id long, seed long, tag long")


def inheritance(jet_leaves: DataFrame, tag_leaves: DataFrame) -> DataFrame:
    """(event_id, tag, jet, share, best): energy share of a jet that comes from a tag; a tag goes to the jet with most of its energy."""
    total = jet_leaves.groupBy("event_id", "jet").agg(F.sum("energy").alias("total"))
    shared = jet_leaves.join(tag_leaves, ["event_id", "leaf"]).groupBy("event_id", "tag", "jet").agg(F.sum("energy").alias("from_tag"))
    w = Window.partitionBy("event_id", "tag").orderBy(F.round("from_tag", 6).desc(), "jet")
    return shared.join(total, ["event_id", "jet"]).select("event_id", "tag", "jet", (F.col("from_tag") / F.col("total")).alias("share"), (F.row_number().over(w) == 1).alias("best"))


def tags_to_quarks(tags: DataFrame, quarks: DataFrame) -> DataFrame:
    """(event_id, tag, quark): closest pairs first, each used once; a tag without a free quark gets -1."""
    q = quarks.select("event_id", F.col("idx").alias("quark"), F.col("phi").alias("qp"), F.col("rapidity").alias("qy"))
    dphi, dy = K.angular_distance(F.col("phi"), F.col("qp")), F.col("rapidity") - F.col("qy")
    near = tags.select("event_id", F.col("idx").alias("tag"), "phi", "rapidity").join(q, "event_id", "left").select("event_id", "tag", F.coalesce("quark", F.lit(-1)).cast("long").alias("quark"), F.coalesce(dphi * dphi + dy * dy, F.lit(float("inf"))).alias("d2"))

    def kernel(e: dict) -> dict:
        found = dict.fromkeys(sorted(set(e["tag"].tolist())), -1)
        used: set[int] = set()
        for k in np.lexsort((e["quark"], e["tag"], e["d2"])):
            t, quark = int(e["tag"][k]), int(e["quark"][k])
            if quark >= 0 and found[t] < 0 and quark not in used:
                found[t] = quark
                used.add(quark)
        return {"event_id": np.full(len(found), e["event_id"][0]), "tag": np.array(list(found)), "quark": np.array(list(found.values()))}

    return per_group(near, ["event_id"], ["tag", "quark"], ["tag", "quark", "d2"], kernel, "event_id long, tag long, quark long")


def same_ancestor_pairs(tags: DataFrame, require_separate: bool) -> DataFrame:
    """(event_id, ancestor, low, high) of tag pairs with one nearest ancestor, in two jets if asked for."""
    a = tags.select("event_id", "ancestor", F.col("tag").alias("low"), F.col("jet").alias("jl"))
    b = tags.select("event_id", "ancestor", F.col("tag").alias("high"), F.col("jet").alias("jh"))
    pairs = a.join(b, ["event_id", "ancestor"]).where("low < high")
    return (pairs.where("jl <> jh") if require_separate else pairs).select("event_id", "ancestor", "low", "high")


def with_n_tags(tags: DataFrame, n: int) -> DataFrame:
    """(event_id, jet) of jets with exactly n tags."""
    return tags.groupBy("event_id", "jet").agg(F.countDistinct("tag").alias("n")).where(F.col("n") == n).select("event_id", "jet")


def compared(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Distances of summed tag and jet momenta per event; the angle is not cyclic. percent_found compares counts."""
    t = truth.select("event_id", *(F.col(c).alias(f"t_{c}") for c in [*MOMENTA, "n"]))
    f = found.select("event_id", *(F.col(c).alias(f"f_{c}") for c in [*MOMENTA, "n"]))
    both = t.join(f, "event_id")
    col = lambda s: [F.col(f"{s}_{c}") for c in MOMENTA]
    pt = lambda s: K.pt(F.col(f"{s}_px"), F.col(f"{s}_py"))
    return both.select(
        "event_id",
        F.abs(pt("t") - pt("f")).alias("pt_distance"),
        F.abs(K.phi(F.col("t_px"), F.col("t_py")) - K.phi(F.col("f_px"), F.col("f_py"))).alias("phi_distance"),
        F.abs(K.rapidity(pt("t"), F.col("t_pz"), F.col("t_energy")) - K.rapidity(pt("f"), F.col("f_pz"), F.col("f_energy"))).alias("rapidity_distance"),
        (K.clipped_mass(*col("f")) / F.nullif(K.clipped_mass(*col("t")), F.lit(0.0))).alias("mass_ratio"),
        (F.col("f_n") / F.col("t_n")).alias("percent_found"),
    )


def jet_labels(inputs: DataFrame, members: DataFrame) -> DataFrame:
    """(event_id, idx, jet): the jet that holds each input, the last of several, -1 for none."""
    last = members.groupBy("event_id", F.col("leaf").alias("idx")).agg(F.max("jet").alias("jet"))
    return inputs.select("event_id", "idx").join(last, ["event_id", "idx"], "left").select("event_id", "idx", F.coalesce("jet", F.lit(-1)).alias("jet"))


def jets_to_groups(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(event_id, jet, seed): the tag group of each tagged jet.

    `links` has event_id, jet, tag and mass2 (the tag's share): a jet of several tags goes by the one of most mass
    (ties: lowest tag). `groups` has event_id, seed and tag; a jet whose tag is in no group is left out.
    """
    of = links.groupBy("event_id", "jet").agg(F.max(F.struct(F.round("mass2", 6).alias("m"), (-F.col("tag")).alias("tag"))).alias("b"))
    first = groups.groupBy("event_id", "tag").agg(F.min("seed").alias("seed"))
    return of.select("event_id", "jet", (-F.col("b.tag")).alias("tag")).join(first, ["event_id", "tag"]).select("event_id", "jet", "seed")
