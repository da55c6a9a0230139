"""Language identification in two steps: the family first, then pairs within the family.

Linear support vector machines over hashed letter trigrams of the whole text. One machine per family
against the others picks the family; within it every two languages have a machine of their own and
vote, so closely related languages are separated by what tells just those two apart. How well the
trigrams of the text fit the language found, against texts of the other training fold, scales the score:
machines only tell languages from each other, and say nothing about a text that is in none of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_bucket, release_memory, table, unit_hash

#: The families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
}
#: Trigram buckets, training rows per language (in expectation, chosen by a hash of the id), SVM settings.
BITS, PER_LANGUAGE, COST, ROUNDS = 12, 600, 4.0, 60
#: Languages that a model can learn, and rows of all of them together.
MOST_LANGUAGES, MOST_ROWS = 200, 24_000
#: A prediction below this score is rejected by the pipeline stage.
LEAST_SCORE = 0.05
#: Robust standard deviations below its language's usual fit at which the fit alone takes a text to LEAST_SCORE,
#: or as many as this share of the training texts exceeds where that is farther.
FAR, FARTHEST = 6.0, 0.005

#: Texts that are judged by one matrix product.
TOGETHER = 256

_LETTERISH = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether some character has a Unicode category L; `re` alone would count signs such as one half."""
    return any(m[0].isalpha() for m in _LETTERISH.finditer(text))


_KEEP = np.full(256, 32, np.uint32)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def features(text: str) -> np.ndarray:
    """Unit vector of root trigram counts; letters and non-ASCII bytes count, all else is a space."""
    a = _KEEP[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    codes = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    blank = (a[:-2] == 32) & (a[1:-1] == 32) & (a[2:] == 32) if len(a) > 2 else np.zeros(0, bool)
    v = np.sqrt(np.bincount(codes[~blank], minlength=1 << BITS).astype(np.float32))
    return v / (np.linalg.norm(v) or 1)


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a squared-hinge linear SVM, classes weighted alike; y is +1 or -1."""
    full = np.c_[x, np.ones(len(x), np.float32)]
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)) / len(y)
    step = 1 / (1 / (COST * 100) + 4 * weight.max() * len(y))
    y, weight = y.astype(np.float32), weight.astype(np.float32)  # so that no step copies the matrix to double
    w = z = np.zeros(full.shape[1], np.float32)
    t = 1.0
    for _ in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (full @ z))
        new = z - np.float32(step) * (z / np.float32(COST * 100) - 2 * (full.T @ (weight * y * slack)))
        after = (1 + sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + np.float32((t - 1) / after) * (new - w), new, after
    return w


class Fit:
    """Mean log-likelihood of a text's trigrams in one language, as deviations from that of its training texts.

    Two folds: each is scored by the other's trigrams. The spread is that between long texts, and that
    between short ones, which falls with the root of the length.
    """

    def __init__(self, x: np.ndarray, sizes: np.ndarray):
        share = x.astype(np.float64) ** 2
        fold = np.arange(len(x)) % 2
        value = np.array([share[i] @ w for k in (0, 1) for w in [self._logs(share[fold != k], sizes[fold != k])] for i in np.flatnonzero(fold == k)])
        size = np.concatenate([sizes[fold == k] for k in (0, 1)])
        self.logs = self._logs(share, sizes)
        long = size >= np.median(size)
        self.usual = float(np.median(value[long]))
        off = np.abs(value - self.usual)
        self.between = max(1.4826 * float(np.median(off[long])), 0.02)
        self.within = 1.4826 * float(np.median((off * np.sqrt(size))[size <= np.median(size)]))
        off = (value - self.usual) / np.sqrt(self.between**2 + self.within**2 / np.maximum(size, 1))
        self.limit = min(-FAR, float(np.quantile(off, FARTHEST)))

    @staticmethod
    def _logs(share: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        mass = (share * sizes[:, None]).sum(0) + 0.5
        return np.log(mass / mass.sum())

    def deviations(self, v: np.ndarray, size: int) -> float:
        return (float((v.astype(np.float64) ** 2) @ self.logs) - self.usual) / sqrt(self.between**2 + self.within**2 / max(size, 1))


class LanguageModel:
    """Families, their machines, and one machine for each two languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str], sizes: list[int]):
        names = sorted(set(langs))
        home = {code: family for family, codes in FAMILIES.items() for code in codes}
        lang = np.array(langs, dtype=object)
        fam = np.array([home.get(n, n) for n in langs], dtype=object)
        self.families = sorted(set(fam.tolist()))
        self.members = {f: [n for n in names if home.get(n, n) == f] for f in self.families}
        size = np.array(sizes, np.float64)
        self.fits = {n: Fit(x[lang == n], size[lang == n]) for n in names if (lang == n).sum() > 1}
        sign = lambda hit: np.where(hit, 1.0, -1.0)
        if len(self.families) == 2:
            first = svm(x, sign(fam == self.families[0]))
            self.outer = [first, -first]
        else:
            self.outer = [svm(x, sign(fam == f)) for f in self.families] if self.families[1:] else []
        self.inner = {}
        for f, found in self.members.items():
            for a, b in combinations(found, 2):
                rows = (lang == a) | (lang == b)
                self.inner[a, b] = svm(x[rows], sign(lang[rows] == a))
        stacked = lambda found: np.stack(found, 1) if found else np.zeros((len(features("")) + 1, 0), np.float32)
        self.outer_matrix, self.inner_matrix = stacked(self.outer), stacked(list(self.inner.values()))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; `und` with score 0 for null, a text without a letter or a model without languages."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if self.families and t and has_letter(t)]
        for at in range(0, len(some), TOGETHER):
            part = some[at : at + TOGETHER]
            x = np.stack([features(texts[i]) for i in part])
            outer = x @ self.outer_matrix[:-1] + self.outer_matrix[-1]
            inner = x @ self.inner_matrix[:-1] + self.inner_matrix[-1]
            for i, v, first, second in zip(part, x, outer.tolist(), inner.tolist(), strict=True):
                out[i] = self._judge(v, len(texts[i]), first, dict(zip(self.inner, second, strict=True)))
        return out

    def _judge(self, v: np.ndarray, size: int, margins: list[float], pairs: dict[tuple[str, str], float]) -> tuple[str, float]:
        family, score = self.families[0], 1.0
        if margins:
            best = max(range(len(margins)), key=lambda i: margins[i])
            rest = max(m for i, m in enumerate(margins) if i != best)
            family, score = self.families[best], 1 / (1 + np.exp(-2 * (margins[best] - rest)))
        found = self.members[family]
        wins, sure = dict.fromkeys(found, 0.0), dict.fromkeys(found, 1.0)
        for a, b in combinations(found, 2):
            p = float(1 / (1 + np.exp(-4 * pairs[a, b])))
            for n, q in ((a, p), (b, 1 - p)):
                wins[n] += (q > 0.5) + 1e-3 * q
                sure[n] = min(sure[n], q)
        lang = max(found, key=lambda n: (wins[n], n))
        return lang, float(score) * sure[lang] * self.fit(lang, v, size)

    def fit(self, lang: str, v: np.ndarray, size: int) -> float:
        """Near one for texts like those of the language, LEAST_SCORE at the limit of their deviations."""
        if lang not in self.fits:
            return 1.0
        beyond = self.fits[lang].limit - self.fits[lang].deviations(v, size)
        return float(1 / (1 + (1 / LEAST_SCORE - 1) * np.exp(np.clip(3 * beyond, -50, 50))))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, least_rows: int = 1) -> LanguageModel:
    """Fit on about `per_language` rows of each language outside the held-out fold.

    Of languages with `least_rows` such rows, the MOST_LANGUAGES most frequent are learned, so that dirty labels
    neither fill the driver nor the model.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold_bucket(F.col("doc_id"), 3) != 1))
    counts = usable.groupBy("lang").count().filter(F.col("count") >= least_rows).orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    per_language = min(per_language, MOST_ROWS // max(1, len(counts)))
    chances = F.create_map(*(F.lit(x) for row in counts for x in (row["lang"], min(1.0, per_language / row["count"])))) if counts else None
    share = F.coalesce(F.try_element_at(chances, F.col("lang")), F.lit(0.0)) if counts else F.lit(0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, features(t).astype(np.float16).tobytes(), g, len(t)) for i, t, g in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], ["doc_id", "v", "lang", "size"])

    chosen = usable.filter(unit_hash(9, F.col("doc_id")) < share).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.struct("lang", "text")).alias("one"))
    chosen = chosen.select("doc_id", "one.text", "one.lang")  # a repeated id counts once, so that it cannot pass the bound
    rows = sorted((r["doc_id"], r["lang"], bytes(r["v"]), r["size"]) for r in chosen.mapInArrow(run, "doc_id long, v binary, lang string, size long").collect())
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float16).reshape(-1, 1 << BITS).astype(np.float32)
    return LanguageModel(x, [r[1] for r in rows], [r[3] for r in rows])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from the whole text alone.

    A null text or one without a letter is `und` with score 0; ties between languages go to the
    alphabetically last; repeated rows get the same answer; very long texts are read whole; an
    empty table gives an empty result; other columns are not read, so their names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null, no letter at all, or a score below LEAST_SCORE.

    One narrow pass over whole texts; columns as they came, whatever their names; repeated rows and ids are
    judged by their own text; an empty table gives an empty result.
    """
    model = train(docs)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        return pa.array([lang != "und" and score >= LEAST_SCORE for lang, score in model.predict_all(texts.to_pylist())], pa.bool_())

    return docs.filter(known(docs["text"].cast("string")))
