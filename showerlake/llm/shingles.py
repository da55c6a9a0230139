"""Groups of texts whose word shingles are alike: bit-sliced fingerprints inside blocks, then whole shingle sets.

At a Jaccard similarity of 0.8 two fingerprints differ in 15 % of their bits, and no bit ranges block such a
radius. So blocks are min-hash bands: bands of five minima find a pair at 0.8 with all but (1 - 0.8^5)^64 =
9e-12. Inside a band fingerprints of 512 bits are compared bit-sliced; a pair at 0.8 differs by 78 of them
(standard deviation 8) and passes below 128 (six deviations). What passes in any band joins texts to
families, and inside a family every two texts are compared on their whole shingle sets. No pairs are
written: a band gives a spanning star of what passed, a cell of a family one of what is alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitslice import bucket_edges, bucket_links
from .common import Scratch, fresh, is_small, join_facts, release_heaps, release_memory, slices, text_mark
from .components import Forest, connected_components

WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 64, 5
SEED = 42
#: Shingles permuted at once, to bound the memory of very long texts.
SPAN = 1 << 11
#: Words of a fingerprint; pairs below 2**COUNTERS differing bits pass, and all where a set is smaller than SMALL (too few for the estimate).
PRINT_WORDS, COUNTERS, SMALL = 8, 7, 32
#: Texts and shingles of a chunk of a family, and texts of a chunk of a band.
CHUNK_TEXTS, CHUNK_SHINGLES, CHUNK_BAND = 1024, 1 << 21, 2048
#: Shared shingles held by more texts than this are counted as a matrix product, and columns of that matrix at a time.
COMMON, COLUMNS = 48, 4096

_RNG = np.random.default_rng(SEED)
_TURNS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 64, PRINT_WORDS, np.uint64)


def shingle_set(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, one without words none."""
    words = data.lower().split()  # as for fingerprints: ASCII case and white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    joined = b" ".join(words)
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:])), np.uint64, len(words) - width + 1)  # noqa: B905
    return np.unique(hashes)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key of each band: the minima of its permutations of the shingles; none without shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low, least = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), SPAN):
        np.minimum(least, (_TURNS * low[None, at : at + SPAN]).min(1), out=least)
    return (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64).view(np.int64)


def class_of(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a shingle set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def wide_print(shingles: np.ndarray) -> bytes:
    """Fingerprint of PRINT_WORDS words: a bit is set if it is in over half of the shingles' mixed hashes."""
    ones = np.zeros(64 * PRINT_WORDS, np.int64)
    for at in range(0, len(shingles), SPAN):
        z = shingles[at : at + SPAN, None] + _PLUS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finaliser of splitmix64
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.col("text").cast("binary").alias("text"))


def _sets_of(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    return (shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column(2))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, mark, cls, bands) of every row: the name of its shingle set and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(class_of(s), band_keys(s)) for s in _sets_of(batch, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["doc_id", "mark", "cls", "bands"])
        release_memory()

    return _texts(docs).mapInArrow(run, "doc_id long, mark long, cls long, bands array<long>")


def sets(docs: DataFrame, width: int) -> DataFrame:
    """(cls, n, fp, shingles) of the distinct shingle sets: their sizes, wide fingerprints and members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = list(_sets_of(batch, width))
            columns = [pa.array([class_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([wide_print(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "fp", "shingles"])
        release_memory()

    return _texts(docs).mapInArrow(run, "cls long, n long, fp binary, shingles binary").dropDuplicates(["cls"])


def _dealt(rows: DataFrame, group: str, chunks: Column) -> DataFrame:
    """`rows` with columns cell, side: all of a group of one chunk in one cell, else a cell for each two chunks.

    `cell` is a 64-bit name; should two names ever clash, their rows are merely compared as well.
    """
    g = F.greatest(F.lit(1), F.ceil(chunks)).cast("long")
    dealt = rows.withColumn("g", g).withColumn("c", F.pmod(F.xxhash64("cls"), F.col("g"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    side = F.when(F.col("c") == F.col("o"), 0).otherwise(F.when(F.col("c") < F.col("o"), 1).otherwise(2))
    return dealt.withColumn("cell", F.when(F.col("g") == 1, F.col(group)).otherwise(F.xxhash64(group, F.least("c", "o"), F.greatest("c", "o")))).withColumn("side", side.cast("long"))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell")


def families(shared: DataFrame, held: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(cls, family): texts joined by fingerprints close enough for this similarity, in any band."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        prints = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(batch), 8 * PRINT_WORDS)
        return [*(np.asarray(batch.column(i)) for i in range(3)), prints]

    def links(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, (moved, root) = rows[2], bucket_links(rows[0], rows[3], COUNTERS, lambda i, j: np.minimum(rows[2][i], rows[2][j]) >= least * np.maximum(rows[2][i], rows[2][j]))
        few = np.flatnonzero(n < SMALL)  # whatever meets a small set in its band joins it
        if not len(few):
            return moved, root
        start = np.searchsorted(rows[0], rows[0])
        small = np.isin(rows[0], rows[0][few]) & (n <= SMALL / least)
        return np.r_[moved, np.flatnonzero(small)], np.r_[root, _first(small, start)]

    facts = held.select("cls", "n", "fp")
    rows = shared.join(F.broadcast(facts) if is_small(facts, 50_000) else facts, "cls")
    cells = _sorted(_dealt(rows, "key", F.col("among") / CHUNK_BAND).select("cell", "cls", "n", "fp"))
    edges = cells.mapInArrow(bucket_edges(links, columns, 1), "a long, b long")
    return connected_components(edges, scratch).select(F.col("node").alias("cls"), F.col("component").alias("family"))


def _first(chosen: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each chosen row of sorted buckets the first chosen row of its bucket."""
    at = np.flatnonzero(chosen)
    new = np.r_[True, start[at][1:] != start[at][:-1]]
    return at[new][np.cumsum(new) - 1]


def alike(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the sets of two lists with at least this Jaccard similarity; sets are sorted and distinct."""
    size = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    flat = np.concatenate([*left, *right])
    owner = np.concatenate([np.repeat(np.arange(len(s)), s) for s in size])
    of_right = np.arange(len(flat)) >= size[0].sum()
    order = np.lexsort((of_right, flat))
    flat, owner, of_right = flat[order], owner[order], of_right[order]
    group = np.cumsum(np.r_[True, flat[1:] != flat[:-1]]) - 1
    n = [np.bincount(group[~of_right], minlength=group[-1] + 1), np.bincount(group[of_right], minlength=group[-1] + 1)]
    met = (n[0] > 0) & (n[1] > 0)
    heavy = met & (n[0] + n[1] > COMMON)
    common = np.zeros((len(left), len(right)), np.float32)
    number = np.cumsum(heavy) - 1
    for at in range(0, int(heavy.sum()), COLUMNS):
        here = heavy[group] & (number[group] >= at) & (number[group] < at + COLUMNS)
        sides = []
        for side, rows in ((False, len(left)), (True, len(right))):
            some = here & (of_right == side)
            matrix = np.zeros((rows, min(COLUMNS, int(heavy.sum()) - at)), np.float32)
            matrix[owner[some], number[group[some]] - at] = 1
            sides.append(matrix)
        common += sides[0] @ sides[1].T
    light = np.flatnonzero((met & ~heavy)[group] & ~of_right)  # each with the right-hand texts of its shingle
    starts, counts = np.cumsum(n[0] + n[1]) - n[1], n[1]
    for part in np.array_split(light, len(light) * COMMON // (1 << 22) + 1):
        k = counts[group[part]]
        j = owner[np.repeat(starts[group[part]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        i = np.repeat(owner[part], k)
        common += np.bincount(i * len(right) + j, minlength=common.size).reshape(common.shape)
    total = size[0][:, None] + size[1][None, :]
    return np.nonzero(common / (total - common).astype(np.float64) >= least)


def compared(families_: DataFrame, held: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that span what is alike inside each family."""

    def links(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        forest = Forest(len(rows[0]))
        bounds = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1], True])
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            side, data = rows[2][start:end], [np.frombuffer(x, np.uint64) for x in rows[3][start:end]]
            one, two = (np.flatnonzero(side != 2), np.flatnonzero(side != 1))
            if len(one) and len(two):
                i, j = alike([data[k] for k in one], [data[k] for k in two], least)
                forest.join(start + one[i], start + two[j])
        moved = np.flatnonzero(forest.flatten() != np.arange(len(rows[0])))
        return moved, forest.root[moved]

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        blobs = np.empty(len(batch), object)
        blobs[:] = batch.column(3).to_pylist()
        return [*(np.asarray(batch.column(i)) for i in range(3)), blobs]

    members = scratch.keep(families_.join(held.select("cls", "n"), "cls"))
    sizes = members.groupBy("family").agg(F.count("*").alias("texts"), F.sum("n").alias("weight"))
    known = join_facts(members.select("cls", "family"), scratch.keep(sizes), ["family"], "texts", members.count())
    rows = known.join(held.select("cls", "shingles"), "cls")
    chunks = F.greatest(F.col("texts") / CHUNK_TEXTS, F.col("weight") / CHUNK_SHINGLES)
    return _sorted(_dealt(rows, "family", chunks).select("cell", "cls", "side", "shingles")).mapInArrow(bucket_edges(links, columns, 1), "a long, b long")


def similar_groups(docs: DataFrame, scratch: Scratch, width: int = WIDTH, least: float = SIMILAR) -> DataFrame:
    """(doc_id, mark, component_id, kept) of every row: components of texts with a Jaccard similarity of at least `least`.

    component_id is the smallest id of the group, kept tells its row (of several texts under that id the one
    with the smaller mark). Equal shingle sets collapse to one class first; null texts and texts without
    words are one class. Rows that share an id each keep their row; nothing is capped, and a band or family
    of any size is dealt out as cells of two chunks each.
    """
    rows = scratch.keep(signatures(docs, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("rep")
    classes = scratch.keep(rows.groupBy("cls").agg(first, F.count("*").alias("n")))
    several = scratch.keep(classes.filter("n > 1").select("cls"))  # most classes are one row, which need not travel to be distinct
    several = F.broadcast(several) if is_small(several) else several
    once = rows.join(several, "cls", "left_anti").select("cls", "bands").union(rows.join(several, "cls", "left_semi").select("cls", "bands").dropDuplicates(["cls"]))
    keyed = once.select("cls", F.explode("bands").alias("key"))
    shared = scratch.keep(keyed.withColumn("among", F.count("*").over(Window.partitionBy("key"))).filter("among > 1"))
    some = classes.join(shared.select("cls").distinct(), "cls").select("rep.doc_id", "rep.mark")
    names = fresh(docs, "some_id", "some_mark")
    ids = scratch.keep(some.toDF(*names))
    wanted = docs["doc_id"].cast("long").eqNullSafe(F.col(names[0])) & (text_mark(docs["text"]) == F.col(names[1]))
    release_heaps(scratch.spark)  # the shuffle of the bands grew them, and the next step is Python's
    held = scratch.keep(sets(docs.join(F.broadcast(ids) if is_small(ids) else ids, wanted, "left_semi"), width))
    found = families(shared, held, least, scratch)
    links = compared(found, held, least, scratch)
    found = connected_components(links, scratch).select(F.col("node").alias("cls"), "component")
    placed = scratch.keep(classes.join(found, "cls", "left").select("cls", "n", "rep", F.coalesce("component", "cls").alias("c")))
    least_ = placed.groupBy("c").agg(F.min("rep").alias("keep"), F.count("*").alias("of"))
    named = scratch.keep(join_facts(placed, scratch.keep(least_), ["c"], "of", placed.count()).select("cls", "n", "keep"))
    out = join_facts(rows.select("doc_id", "mark", "cls"), named, ["cls"], "n", rows.count())
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("mark") == F.col("keep.mark"))
    return out.select("doc_id", "mark", F.col("keep.doc_id").alias("component_id"), kept.alias("kept"))
