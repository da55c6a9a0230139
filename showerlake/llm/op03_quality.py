"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees on a bounded labelled sample yield paths; each path is a conjunctive rule over the
statistics. A lasso logistic fit keeps few of them, and what is kept becomes one Spark column expression.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_bucket, table, unit_hash
from .trees import grow, paths, predict

#: Labelled rows that a fit may use (in expectation; chosen by a hash of the id).
SAMPLE = 8000
TREES, TREE_DEPTH, LEAST, RATE = 24, 3, 20, 0.3
PENALTY, ROUNDS = 0.002, 400
THRESHOLD = 0.3

STATS = ["log_words", "word_length", "upper", "digits", "stops", "marks", "symbols", "bars", "wide", "lines", "distinct", "top_word", "runs", "same_lines", "odd_words"]


def _members(chars: bytes) -> np.ndarray:
    return np.frombuffer(chars, np.uint8)


UPPER, LOWER, DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
SPACE, STOP, MARK = _members(b" \t\n\r\x0b\x0c"), _members(b".,;:"), _members(b"!?")
SYMBOL = _members(b"#$%&*+/<=>@\\^_`{}~[]")


def statistics(data: bytes) -> tuple[float, ...]:
    """The numbers of STATS for one whole UTF-8 text; all zero for an empty one."""
    words = data.split()
    if not words:
        return (0.0,) * len(STATS)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = len(data), len(words)
    letters = int(seen[UPPER].sum() + seen[LOWER].sum()) or 1
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda group: float(seen[group].sum()) / size
    return (
        float(np.log1p(n)),
        (size - int(seen[SPACE].sum())) / n,
        float(seen[UPPER].sum()) / letters,
        share(DIGIT), share(STOP), share(MARK), share(SYMBOL),
        float(seen[124]) / n,
        float(seen[128:].sum()) / size,
        len(lines) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        sum(1 for w in counts if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,") / len(counts),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, *STATS) of every row; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t or b"") for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATS)))], ["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic fit (accelerated proximal gradient)."""
    n, m = x.shape
    full = np.c_[np.ones(n), x]
    step = 4.0 / (np.linalg.norm(full, 2) ** 2 / n)
    w, z, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    w[0] = z[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for _ in range(rounds):
        new = z - step * (full.T @ (1 / (1 + np.exp(-np.clip(full @ z, -30, 30))) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


class RuleModel:
    """Weighted conjunctive rules; `score` is the compiled column."""

    def __init__(self, intercept: float, rules: list[tuple[float, tuple]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            hold = None
            for feature, is_low, cut in rule:
                one = F.col(STATS[feature]) <= cut if is_low else F.col(STATS[feature]) > cut
                hold = one if hold is None else hold & one
            total = total + F.when(hold, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, is_low, cut in rule:
        out &= (x[:, feature] <= cut) == is_low
    return out


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Trees by gradient boosting, their paths as rules, lasso weights. One class or no rows: a constant."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(p / (1 - p))), [])
    margin, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(x, y - p, TREE_DEPTH, LEAST)
        margin += RATE * predict(tree, x) / max(float((p * (1 - p)).mean()), 1e-3)
        margin = np.clip(margin, -8, 8)
        for rule in paths(tree):
            held = _holds(rule, x)
            found.setdefault(held.tobytes(), (rule, held))
    rules = [r for r, h in found.values() if 0 < h.mean() < 1]
    if not rules:
        return RuleModel(float(margin.mean()), [])
    matrix = np.stack([_holds(r, x) for r in rules], 1).astype(np.float64)
    intercept, weights = lasso_logistic(matrix, y, PENALTY, ROUNDS)
    return RuleModel(intercept, [(float(w), r) for w, r in zip(weights, rules, strict=True) if w])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Fit on at most about `sample` labelled documents outside the held-out fold.

    An id with several labels counts once, by their majority (0 if even); an id with several texts by the one
    of the smallest statistics, so that repeated rows do not pass the bound.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_bucket(F.col("doc_id"), 5) != 0))
    usable = usable.groupBy(F.col("doc_id").alias("l_id")).agg(F.when(F.avg("quality") > 0.5, 1).otherwise(0).alias("l_quality"))
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.filter(unit_hash(3, F.col("l_id")) < share)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen.select("l_id")), F.col("doc_id") == F.col("l_id"), "left_semi"))
    once = rows.groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "s.*")
    table_ = once.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "l_quality", *STATS).toPandas().sort_values("doc_id")
    return fit_rules(table_[STATS].to_numpy(float), table_["l_quality"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null counts as empty, whose statistics are all zero; repeated rows and ties score alike; very long texts
    are read whole; an empty table gives an empty result. Only doc_id and text are read, so other names cannot
    clash, and the id only picks the fold.
    """
    return with_statistics(docs).select("doc_id", F.coalesce(fold_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), model.score().alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
