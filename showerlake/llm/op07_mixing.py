"""Mixing sources to target weights by iterative proportional fitting.

Token masses of the cells source x language x topic are raked until their marginals match the targets.
A cell's fitted mass over its own mass is its weight; weights are calibrated to probabilities, and a
document is kept when the hash of its id falls below that of its cell.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table, unit_hash

MARGINS = ["source", "lang", "topic"]
#: Default targets are the observed shares to this power, made to sum to one.
TEMPER = 0.9
ROUNDS, TOLERANCE = 60, 1e-9
#: Share of the token mass whose weights the calibration must leave below probability one.
UNCAPPED = 0.995
#: Cells that are raked on the driver; more are raked as tables.
MOST_CELLS = 200_000
SEED = 7


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def genre(text: Column, tokens: Column) -> Column:
    """Topic of a document by its form: a table, something short, prose or long prose."""
    return F.when(F.coalesce(F.contains(text, F.lit(" | ")), F.lit(False)), "table").when(tokens < 50, "short").when(tokens < 1500, "prose").otherwise("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every row; a null source or language is a category of its own."""
    none = F.lit("\u0000none")
    base = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), none).alias("source"), F.coalesce(F.col("lang").cast("string"), none).alias("lang"), F.col("text").cast("string").alias("text"), n_tokens(F.col("text").cast("string")).alias("tokens"))
    return base.select("doc_id", "source", "lang", genre(F.col("text"), F.col("tokens")).alias("topic"), "tokens")


def tempered(shares: dict[str, float], temper: float = TEMPER) -> dict[str, float]:
    powered = {k: v**temper for k, v in shares.items() if v > 0}
    total = sum(powered.values())
    return {k: v / total for k, v in powered.items()}


def rake(keys: list[np.ndarray], mass: np.ndarray, targets: list[dict], rounds: int = ROUNDS) -> np.ndarray:
    """Weights w of the cells such that each marginal of w * mass has its target's shares."""
    w = np.ones(len(mass))
    total = mass.sum()
    found = [np.unique(k, return_inverse=True) for k in keys]
    wanted = []
    for (names, _), target in zip(found, targets, strict=True):
        t = np.array([max(0.0, target.get(n, 0.0)) for n in names.tolist()])
        wanted.append(t / t.sum() * total if t.sum() > 0 else None)
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for (_, at), want in zip(found, wanted, strict=True):
            if want is None:
                continue
            have = np.bincount(at, weights=w * mass, minlength=len(want))
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(factor - 1).max(initial=0)))
            w *= factor[at]
        if worst < TOLERANCE:
            break
    _report(worst, rounds)
    return w


def rake_tables(cells: DataFrame, targets: list[dict] | None, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """The same on tables, for more cells than the driver takes; lineage is cut each round."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("mass")).first()[0] or 0.0
    wanted = []
    for i, m in enumerate(MARGINS):
        if targets is None:
            share = cells.groupBy(m).agg(F.sum("mass").alias("t")).withColumn("t", F.pow("t", F.lit(TEMPER)))
        else:
            given = [(k, max(0.0, float(v))) for k, v in targets[i].items()]
            share = spark.createDataFrame(given, f"{m} string, t double").join(cells.select(m).distinct(), m)
        sum_ = share.agg(F.sum("t")).first()[0] or 0.0
        if sum_ > 0:
            wanted.append((m, scratch.keep(share.select(m, (F.col("t") * (total / sum_)).alias("want")))))
    out, worst = scratch.keep(cells.withColumn("w", F.lit(1.0))), 0.0
    for _ in range(rounds):
        after = out.withColumn("step", F.lit(0.0))
        for m, want in wanted:
            have = after.groupBy(m).agg(F.sum(F.col("w") * F.col("mass")).alias("have"))
            factor = have.join(want, m, "left").select(m, F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(1.0).alias("f"))
            after = after.join(factor, m).select(*MARGINS, "mass", (F.col("w") * F.col("f")).alias("w"), F.greatest("step", F.abs(F.col("f") - 1)).alias("step"))
        before, out = out, scratch.keep(after)
        scratch.drop(before)
        worst = out.agg(F.max("step")).first()[0] or 0.0
        if worst < TOLERANCE:
            break
    _report(worst, rounds)
    return out.drop("step")


def _report(worst: float, rounds: int) -> None:
    if worst >= TOLERANCE:
        warnings.warn(f"mixing has not converged: a margin still moved by {worst:.2e} in round {rounds}", RuntimeWarning, stacklevel=3)


def weight_below(raked: DataFrame, goal: float) -> float:
    """The least weight up to which the cells hold `goal` of the mass; exact, each pass brings 1,001 rows at most."""
    low, high = raked.agg(F.min("w"), F.max("w")).first()
    below = 0.0
    while low < high:
        inside = raked.filter(F.col("w").between(low, high)).withColumn("bin", F.floor((F.col("w") - low) / (high - low) * 1000))
        bins = inside.groupBy("bin").agg(F.sum("mass").alias("m"), F.min("w").alias("low"), F.max("w").alias("high")).orderBy("bin").collect()
        for row in bins:
            low, high = row["low"], row["high"]
            if below + row["m"] >= goal:
                break
            below += row["m"]
    return low


def cell_probabilities(rows: DataFrame, scratch: Scratch, targets: list[dict] | None = None, most_cells: int = MOST_CELLS) -> tuple[DataFrame, bool]:
    """(source, lang, topic, weight, prob) of each cell, and whether the table is known to be small.

    Probabilities are weights times one factor, the largest for which cells with UNCAPPED of the mass stay
    at or below one; the rest is capped at one.
    """
    spark = rows.sparkSession
    cells = scratch.keep(rows.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("mass")))
    schema = "source string, lang string, topic string, weight double, prob double"
    if cells.limit(most_cells + 1).count() > most_cells:
        raked = rake_tables(cells, targets, scratch)
        limit = weight_below(raked, UNCAPPED * (raked.agg(F.sum("mass")).first()[0] or 0.0))
        prob = F.least(F.lit(1.0), F.col("w") / limit) if limit > 0 else F.lit(1.0)
        return raked.select(*MARGINS, F.col("w").alias("weight"), prob.alias("prob")), False
    found = sorted(tuple(r) for r in cells.collect())
    if not found:
        return spark.createDataFrame([], schema), True
    keys, mass = [np.array([r[i] for r in found], dtype=object).astype(str) for i in range(3)], np.array([r[3] for r in found])
    if mass.sum() == 0:
        return spark.createDataFrame([(*r[:3], 1.0, 1.0) for r in found], schema), True
    if targets is None:
        targets = [tempered({n: float(mass[k == n].sum()) for n in np.unique(k).tolist()}) for k in keys]
    w = rake(keys, mass, targets)
    order = np.argsort(w, kind="stable")
    limit = w[order][min(len(w) - 1, int(np.searchsorted(np.cumsum(mass[order]), UNCAPPED * mass.sum())))]
    prob = np.minimum(1.0, w / limit) if limit > 0 else np.ones(len(w))
    return spark.createDataFrame([(*r[:3], float(a), float(b)) for r, a, b in zip(found, w, prob, strict=True)], schema), True


def mix(docs: DataFrame, scratch: Scratch, targets: list[dict] | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, prob, kept) of every row.

    `targets` are shares for source, lang and topic; a category without a target gets weight zero, targets
    without rows are left out. Null or empty texts have no tokens and the weight of their cell; rows that
    share an id share the draw; an empty table gives an empty result.
    """
    rows = measured(docs)
    cells, small = cell_probabilities(rows, scratch, targets, most_cells)
    joined = rows.join(F.broadcast(cells) if small else cells, MARGINS)
    return joined.select("doc_id", *MARGINS, "tokens", "weight", "prob", (unit_hash(SEED, F.col("doc_id")) < F.col("prob")).alias("kept"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, targets: list[dict] | None = None) -> DataFrame:
    """The documents that the draw keeps; columns as they came, whatever their names; one pass for the cells and one to sample.

    `targets` are as for mix(). Null or empty texts have no tokens and the probability of their cell; rows that
    share an id share the draw within their cell; very long texts count whole; an empty table gives an empty result.
    """
    cells, small = cell_probabilities(measured(docs), Scratch(spark, "mix"), targets)
    names = fresh(docs, *MARGINS, "prob")
    cells = cells.select(*MARGINS, "prob").toDF(*names)
    none = F.lit("\u0000none")
    text = docs["text"].cast("string")
    keys = [F.coalesce(docs["source"].cast("string"), none), F.coalesce(docs["lang"].cast("string"), none), genre(text, n_tokens(text))]
    same = (keys[0] == F.col(names[0])) & (keys[1] == F.col(names[1])) & (keys[2] == F.col(names[2]))
    kept = docs.join(F.broadcast(cells) if small else cells, same)
    return kept.filter(unit_hash(SEED, docs["doc_id"]) < F.col(names[3])).select(*(docs[c] for c in docs.columns))
