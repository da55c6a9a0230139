"""Embedding near-duplicates by product quantisation over inverted lists.

Unit vectors are filed under the nearest of K coarse centroids; the residual is cut into subspaces with a
codebook each. A query looks up its distance tables (asymmetric: the query itself is not quantised) in all
lists that are not much farther from it than the nearest. The codes' own error is stored with them, so table value plus error bounds the cosine from
above and nothing inside a probed list is lost; what passes the bound is ranked again by the exact cosine
in double precision. Lists are worked in cells of bounded size; a cell returns link counts and a spanning
star, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Scratch, join_facts, table, unit_hash
from .components import Forest, connected_components

COSINE = 0.9
#: Vectors that train the quantiser (in expectation, chosen by hash): so many, or so many per list if that is more.
SAMPLE, SAMPLE_PER_LIST = 12_000, 8
#: Vectors per list, and bounds of the list count.
PER_LIST, LEAST_LISTS, MOST_LISTS = 256, 8, 4096
#: A query looks into every list whose centroid is at most this many standard deviations farther from it than the
#: nearest one: of two unit vectors at COSINE in d dimensions, one lies off the other by sqrt(1 - COSINE**2) in a
#: direction whose cosines with two centroids differ by sqrt(2 / d). So the share of lists does not shrink as they grow.
DEVIATIONS = 2.5
#: Subspaces and codewords of each.
SUBSPACES, CODEWORDS = 8, 256
#: Rows of a cell: stored vectors and queries.
CELL_STORED, CELL_QUERIES = 512, 1024


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        owner = np.concatenate([(part @ centers.T - (0 if spherical else (centers**2).sum(1) / 2)).argmax(1) for part in np.array_split(x, -(-len(x) // 2048))])
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, x)
        n = np.bincount(owner, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
        if spherical:
            norm = np.linalg.norm(centers, axis=1, keepdims=True)
            centers = np.where(norm > 0, centers / np.maximum(norm, 1e-12), x[rng.integers(len(x), size=k)])
    return centers


class Quantiser:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int):
        rng = np.random.default_rng(6)
        lists = min(lists, len(sample))
        self.coarse = _kmeans(sample, lists, 8, rng, True)
        residual = sample - self.coarse[self.near(sample, 1)[:, 0]]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(residual[:, c], min(CODEWORDS, len(sample)), 6, rng, False) for c in self.cuts]

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        n, out = min(n, len(self.coarse)), []
        for at in range(0, len(x), 1024):
            sims = x[at : at + 1024] @ self.coarse.T
            top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
            out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out) if out else np.zeros((0, n), np.int64)

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each row looks into, nearest first."""
        margin, out = DEVIATIONS * np.sqrt((1 - COSINE**2) * 2 / max(1, x.shape[1])), []
        for at in range(0, len(x), 1024):
            sims = x[at : at + 1024] @ self.coarse.T
            rows, lists = np.nonzero(sims >= sims.max(1, keepdims=True) - margin)
            order = np.lexsort((lists, -sims[rows, lists], rows))
            out += np.split(lists[order].astype(np.int32), np.cumsum(np.bincount(rows, minlength=len(sims)))[:-1])
        return out

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subspace codes of the residuals, and the norm of what the codes miss."""
        residual = x - self.coarse[lists]
        codes, error = np.empty((len(x), len(self.cuts)), np.uint8), np.zeros(len(x))
        for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = residual[:, cut]
            codes[:, m] = (part @ book.T - (book**2).sum(1) / 2).argmax(1)
            error += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def approximate(self, queries: np.ndarray, centroid: int, codes: np.ndarray) -> np.ndarray:
        """Cosines of exact queries with coded vectors of one list, by table lookup."""
        out = np.repeat((queries @ self.coarse[centroid])[:, None], len(codes), 1)
        for m, (cut, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (queries[:, cut] @ book.T)[:, codes[:, m]]
        return out


def _matrix(blobs: list[bytes], kind: str) -> np.ndarray:
    """Vectors in double precision from their stored form, `<f4` or `<f8`."""
    raw = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1) if blobs else np.zeros((0, 0))
    return raw.astype(np.float64, copy=False)


def stored_kind(vectors: DataFrame) -> str:
    """Single precision where the column has no more, so nothing is lost and half the bytes travel."""
    element = vectors.schema["embedding"].dataType.elementType
    return "<f4" if isinstance(element, FloatType) else "<f8"


def _unit(x: np.ndarray) -> np.ndarray:
    peak = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(peak > 0, peak, 1)  # so that squares neither overflow nor vanish
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def usable(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, cls, other, v): all rows; cls and other, two hashes that name the vector, are null where it cannot link.

    It can if it is not null, not zero and has no null or non-finite component.
    """
    element = "float" if kind == "<f4" else "double"
    v = F.col("embedding").cast(f"array<{element}>")
    finite = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False)) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).select("vec_id", F.when(finite, F.col("v")).alias("v"))
    name = lambda seed: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v"))
    return rows.select("vec_id", name(1).alias("cls"), name(2).alias("other"), "v")


def pack(rows: DataFrame, kind: str) -> DataFrame:
    """(vec_id, cls, other, blob) from (vec_id, cls, other, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.asarray(v.values).astype(kind).tobytes() for v in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], ["vec_id", "cls", "other", "blob"])

    return rows.mapInArrow(run, "vec_id long, cls long, other long, blob binary")


def train(classes: DataFrame, count: int, kind: str, sample: int = SAMPLE) -> Quantiser | None:
    """Quantiser of about `sample` vectors, more for many lists; None for an empty table."""
    lists = int(min(MOST_LISTS, max(LEAST_LISTS, -(-count // PER_LIST))))
    share = min(1.0, max(sample, SAMPLE_PER_LIST * lists) / max(1, count))
    rows = sorted((r["rep"], bytes(r["blob"])) for r in classes.filter(unit_hash(6, F.col("rep")) < share).select("rep", "blob").collect())
    if not rows:
        return None
    return Quantiser(_unit(_matrix([r[1] for r in rows], kind)), lists)


def near_links(classes: DataFrame, quantiser: Quantiser, kind: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(counts, edges) of the links between distinct vectors.

    counts: rep and how many rows (not classes) link to it; edges: spanning links. A pair is seen in the
    list of either vector that the other one probes; from the probes that travel with a vector each cell
    knows whether the other side will see the pair too, so every link counts once.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(1).to_pylist(), kind))
            if not len(x):
                continue
            probes = quantiser.probes(x)
            codes, error = quantiser.encode(x, np.array([p[0] for p in probes]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(probes, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                ["rep", "blob", "n", "probes", "code", "error"],
            )

    placed = scratch.keep(classes.select("rep", "blob", "n").mapInArrow(place, "rep long, blob binary, n long, probes array<int>, code binary, error double"))
    home = F.element_at("probes", 1)
    stored_n = placed.groupBy(home.alias("list")).agg(F.count("*").alias("s"))
    asked_n = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("q"))
    # at most MOST_LISTS rows
    sizes = F.broadcast(stored_n.join(asked_n, "list").select("list", F.ceil(F.col("s") / CELL_STORED).alias("gs"), F.ceil(F.col("q") / CELL_QUERIES).alias("gq")))
    cast = ["rep", "blob", "n", "probes", "code", "error"]
    stored = placed.withColumn("list", home).join(sizes, "list").select("list", *cast, F.lit(True).alias("is_stored"), F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("gs")).alias("cs"), F.explode(F.sequence(F.lit(0), F.col("gq") - 1)).alias("cq"))
    # a query needs its home list only, and neither codes nor their error
    slim = ["rep", "blob", "n", F.slice("probes", 1, 1).alias("probes"), F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error")]
    asked = placed.withColumn("list", F.explode("probes")).join(sizes, "list").select("list", *slim, F.lit(False).alias("is_stored"), F.explode(F.sequence(F.lit(0), F.col("gs") - 1)).alias("cs"), F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("gq")).alias("cq"))

    def cell(rows: pa.Table) -> pa.Table:
        mark = np.asarray(rows["is_stored"])
        sides = []
        for want in (False, True):
            side = rows.filter(pa.array(mark == want))
            sides.append((np.asarray(side["rep"]), _unit(_matrix(side["blob"].to_pylist(), kind)), np.asarray(side["n"]), side["probes"].to_pylist(), side["code"].to_pylist(), np.asarray(side["error"])))
        (q_id, q, q_n, q_probes, _, _), (s_id, s, s_n, s_probes, s_code, s_error) = sides
        a, b, n = [], [], []
        if len(q_id) and len(s_id):
            here = rows["list"][0].as_py()
            codes = np.frombuffer(b"".join(s_code), np.uint8).reshape(len(s_id), -1)
            s_sets = [frozenset(p) for p in s_probes]
            q_home = [p[0] for p in q_probes]
            ids, at = np.unique(np.concatenate([q_id, s_id]), return_inverse=True)
            forest, q_got, s_got = Forest(len(ids)), np.zeros(len(q_id), np.int64), np.zeros(len(s_id), np.int64)
            meets = np.array([[home_ in s_set for home_ in sorted(set(q_home))] for s_set in s_sets])
            column = {h: i for i, h in enumerate(sorted(set(q_home)))}
            for start in range(0, len(q_id), 256):
                part = slice(start, start + 256)
                maybe = quantiser.approximate(q[part], here, codes) + s_error[None, :] >= COSINE - 1e-9
                i, j = np.nonzero(maybe)
                i += start
                keep = q_id[i] != s_id[j]
                i, j = i[keep], j[keep]
                hit = np.einsum("ij,ij->i", q[i], s[j]) >= COSINE
                i, j = i[hit], j[hit]
                if not len(i):
                    continue
                np.add.at(q_got, i, s_n[j])
                # the stored side counts here unless it meets the query in the query's own list, or in this one
                homes = np.array([q_home[k] for k in i.tolist()])
                back = (homes == here) | meets[j, [column[h] for h in homes.tolist()]]
                np.add.at(s_got, j[~back], q_n[i[~back]])
                forest.join(at[i], at[len(q_id) + j])
            moved = np.flatnonzero(forest.flatten() != np.arange(len(ids)))
            for who, got in ((q_id, q_got), (s_id, s_got)):
                some = np.flatnonzero(got)
                a.append(who[some]), b.append(np.full(len(some), -1)), n.append(got[some])
            a.append(ids[moved]), b.append(ids[forest.root[moved]]), n.append(np.zeros(len(moved), np.int64))
        join = lambda parts: pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
        return pa.Table.from_arrays([join(a), join(b), join(n)], ["a", "b", "n"])

    found = scratch.keep(stored.union(asked.select(stored.columns)).groupBy("list", "cs", "cq").applyInArrow(cell, "a long, b long, n long"))
    return found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("links")), found.filter("n = 0").select("a", "b")


def near_duplicates(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, one row for each.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths do not link. Equal vectors form one class before any search, so copies of any number
    cost one comparison; the counts stand for rows. Rows that repeat a vector or an id count as rows, and
    each vector under a shared id is judged by itself. An empty table gives an empty result; other columns
    are not read, so their names cannot clash.
    """
    kind = stored_kind(vectors)
    rows = usable(vectors, kind)
    members = scratch.keep(rows.select("vec_id", "cls"))
    packed = pack(rows.filter("cls IS NOT NULL"), kind)
    classes = scratch.keep(packed.groupBy("cls", "other").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("blob").alias("blob")))
    lengths = [(r[0], r[1]) for r in classes.groupBy(F.octet_length("blob")).count().filter("count > 1").collect()]
    counts = edges = None
    for length, count in sorted(lengths):
        same = classes.filter(F.octet_length("blob") == length).select(F.col("cls").alias("rep"), "blob", "n")
        got, links = near_links(same, train(same, count, kind), kind, scratch)
        counts, edges = (got, links) if counts is None else (counts.union(got), edges.union(links))
    named = classes.select("cls", "first", "n", F.lit(0).alias("links"), F.col("cls").alias("c"))
    if counts is not None:
        comps = connected_components(edges, scratch)
        joined = classes.join(counts, F.col("cls") == F.col("a"), "left").join(comps, F.col("cls") == F.col("node"), "left")
        named = joined.select("cls", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("c"))
    named = scratch.keep(named)
    lowest = scratch.keep(named.groupBy("c").agg(F.min("first").alias("component_id"), F.count("*").alias("of")))
    facts = scratch.keep(join_facts(named, lowest, ["c"], "of", classes.count()).select("cls", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"))
    found = join_facts(members.filter("cls IS NOT NULL"), facts, ["cls"], "n", members.count()).select("vec_id", "n_links", "component_id")
    alone = members.filter("cls IS NULL").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    result = found.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op6"))
