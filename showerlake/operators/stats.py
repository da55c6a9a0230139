"""Statistics between groups: Rand index, rank correlation, ROC area, two-sample distances."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_sums


def rand_index(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Adjusted Rand index of two labellings per key, from the contingency table; 1 where both are trivial."""
    two = lambda c: c * (c - 1) / 2.0
    cells = rows.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    left = cells.groupBy(*keys, a).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two(F.col("n"))).alias("sa"), F.sum("n").alias("total"))
    right = cells.groupBy(*keys, b).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two(F.col("n"))).alias("sb"))
    both = cells.groupBy(*keys).agg(F.sum(two(F.col("n"))).alias("s")).join(left, keys).join(right, keys)
    pairs = two(F.col("total"))
    expected = F.when(pairs > 0, F.col("sa") * F.col("sb") / F.when(pairs > 0, pairs)).otherwise(0.0)
    top, room = F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2.0 - expected
    return both.select(*keys, F.when(room == 0, 1.0).otherwise(top / F.when(room != 0, room)).alias("rand"))


def average_ranks(rows: DataFrame, column: str, name: str, by: list[str]) -> DataFrame:
    """Rank with ties averaged. Ranks come from counts of distinct values, so a common value is one row."""
    values = rows.groupBy(*by, column).agg(F.count("*").alias("__n"))
    ranked = running_sums(values, by, [column], {"__upto": "__n"}).select(*by, column, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    return rows.join(ranked, [*by, column])


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(rows, x, "__rx", by), y, "__ry", by)
    return ranked.groupBy(*by).agg(F.corr("__rx", "__ry").alias("spearman"))


def roc_auc(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve by rank sums; null with one class only."""
    ranked = average_ranks(rows, score, "__r", by)
    hit = F.col(label) == 1
    sums = ranked.groupBy(*by).agg(F.sum(F.when(hit, F.col("__r"))).alias("s"), F.count(F.when(hit, 1)).alias("p"), F.count(F.when(~hit, 1)).alias("q"))
    area = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / F.when(F.col("p") * F.col("q") > 0, F.col("p") * F.col("q"))
    return sums.select(*by, area.alias("auc"))


def kolmogorov_smirnov(rows: DataFrame, value: str, side: str, by: list[str]) -> DataFrame:
    """Largest gap between the two cumulative distributions; `side` is 0 or 1."""
    counts = rows.groupBy(*by, value).agg(F.count(F.when(F.col(side) == 0, 1)).alias("a"), F.count(F.when(F.col(side) == 1, 1)).alias("b"))
    running = running_sums(counts, by, [value], {"ca": "a", "cb": "b"}).select(*by, "ca", "cb")
    totals = counts.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return running.join(totals, by).groupBy(*by).agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"))


def _histograms(rows: DataFrame, value: str, side: str, by: list[str], bins: int) -> DataFrame:
    """(by, bin, p, q): shares of both sides in equal bins over the pooled range."""
    span = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / F.when(width != 0, width)), F.lit(bins - 1))).cast("int")
    counts = rows.join(span, by).groupBy(*by, bin_.alias("bin")).agg(F.count(F.when(F.col(side) == 0, 1)).alias("a"), F.count(F.when(F.col(side) == 1, 1)).alias("b"))
    totals = counts.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return counts.join(totals, by).select(*by, "bin", (F.col("a") / F.col("na")).alias("p"), (F.col("b") / F.col("nb")).alias("q"))


def jensen_shannon(rows: DataFrame, value: str, side: str, by: list[str], bins: int = 20) -> DataFrame:
    """Square root of the divergence, natural logarithm."""
    h = _histograms(rows, value, side, by, bins)
    m = (F.col("p") + F.col("q")) / 2.0
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.when(F.col(c) > 0, F.col(c) / m))).otherwise(0.0)
    return h.groupBy(*by).agg(F.sqrt(F.greatest(F.sum((term("p") + term("q")) / 2.0), F.lit(0.0))).alias("js"))


def kullback_leibler(rows: DataFrame, value: str, side: str, by: list[str], bins: int = 20) -> DataFrame:
    """Over bins that both sides occupy."""
    h = _histograms(rows, value, side, by, bins).where("p > 0 and q > 0")
    return h.groupBy(*by).agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))


def epps_singleton(rows: DataFrame, value: str, side: str, by: list[str], points: tuple[float, ...] = (0.4, 0.8)) -> DataFrame:
    """(by, statistic) of the test on empirical characteristic functions at `points` over half the pooled quartile range.

    One pass gathers means and covariances of the cosines and sines; what is left per key is one row, and
    a matrix of twice as many rows as points to solve.
    """
    span = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    scale = F.nullif((F.col("__q")[1] - F.col("__q")[0]) / 2.0, F.lit(0.0))
    x = rows.join(span, by).withColumn("__x", F.col(value) / scale)
    waves = [f(F.col("__x") * t) for t in points for f in (F.cos, F.sin)]
    m = len(waves)
    wide = x.select(*by, side, *(w.alias(f"__w{i}") for i, w in enumerate(waves)))
    part = lambda s, c: F.when(F.col(side) == s, c)
    aggregates = []
    for s in (0, 1):
        aggregates += [F.count(part(s, F.lit(1))).cast("double").alias(f"n{s}")]
        aggregates += [F.avg(part(s, F.col(f"__w{i}"))).alias(f"m{s}_{i}") for i in range(m)]
        aggregates += [F.covar_pop(part(s, F.col(f"__w{i}")), part(s, F.col(f"__w{j}"))).alias(f"c{s}_{i}_{j}") for i in range(m) for j in range(i, m)]
    sums = wide.groupBy(*by).agg(*aggregates)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                n, cov, mean = [row["n0"], row["n1"]], [], []
                for s in (0, 1):
                    c = np.array([[row[f"c{s}_{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], float)
                    cov.append(c)
                    mean.append(np.array([row[f"m{s}_{i}"] for i in range(m)], float))
                total = sum(n)
                if min(n) < 1 or not np.isfinite(np.concatenate(mean)).all():
                    out.append(float("nan"))
                    continue
                pooled = total / n[0] * cov[0] + total / n[1] * cov[1]
                d = mean[0] - mean[1]
                small = 1 / (1 + total**-0.45 + 10.1 * (n[0] ** -1.7 + n[1] ** -1.7)) if max(n) < 25 else 1.0
                out.append(float(small * total * d @ np.linalg.pinv(pooled) @ d))
            yield pdf[by].assign(statistic=out)

    kinds = ", ".join(f"{name} {kind}" for name, kind in sums.select(*by).dtypes)
    return sums.mapInPandas(solve, f"{kinds}, statistic double")


def subsample_normalised(rows: DataFrame, value: str, side: str, order: list[str], by: list[str], distance: Callable[..., DataFrame], subsamples: int = 3) -> DataFrame:
    """(by, dissimilarity): 2 n d(side 0, side 1) over the sum of d(prefix, suffix) at the n - 2 inner split points of each side.

    `distance` is one of the two-sample functions above. n is `subsamples`, or a fifth of the smaller side
    where that is less; without a split point or with splits that do not differ there is no value (null).
    """
    w = Window.partitionBy(*by, side)
    placed = rows.where(F.col(value).isNotNull()).select(*by, side, value, (F.row_number().over(w.orderBy(*order)) - 1).alias("__at"), F.count("*").over(w).alias("__n"))
    sizes = placed.groupBy(*by).agg(F.count(F.when(F.col(side) == 0, 1)).alias("a"), F.count(F.when(F.col(side) == 1, 1)).alias("b"))
    sizes = sizes.select(*by, F.least(F.floor(F.col("a") / 5), F.floor(F.col("b") / 5), F.lit(subsamples)).cast("int").alias("__k"))
    split = placed.join(sizes, by).where("__k > 2").withColumn("__split", F.explode(F.sequence(F.lit(1), F.col("__k") - 2)))
    half = F.when(F.col("__at") < F.floor(F.col("__split") * F.col("__n") / (F.col("__k") - 1)), 0).otherwise(1)
    inner = distance(split.select(*by, F.col(side).alias("__own"), "__split", value, half.alias("__half")), value, "__half", [*by, "__own", "__split"])
    sums = inner.groupBy(*by).agg(F.sum(inner.columns[-1]).alias("__sum"))
    whole = distance(placed.select(*by, side, value), value, side, by)
    found = whole.withColumnRenamed(whole.columns[-1], "__d").join(sizes, by).join(sums, by, "left")
    return found.select(*by, (2 * F.col("__k") * F.col("__d") / F.nullif("__sum", F.lit(0.0))).alias("dissimilarity"))
