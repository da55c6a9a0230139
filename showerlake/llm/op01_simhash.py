"""SimHash near-duplicates: bit-sliced comparison inside blocks that must agree.

A fingerprint is cut into five bit ranges. Two fingerprints at most three bits apart agree on at least
two of the ranges, so each of the ten pairs of ranges is a bucket key of 25 or 26 bits and no link is
lost. Inside a bucket the candidates stand as vertical bit planes whose distances advance together through
carry-save counters, and words of lanes are abandoned once all are beyond the radius (bitslice.py).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitslice import bucket_edges, bucket_links
from .common import Scratch, join_facts, release_memory, table, text_mark, without
from .components import connected_components
from .shingles import similar_groups

#: Two counters: fingerprints link at 3 or fewer differing bits.
SHINGLE = 3
SEED = 42
#: Bit ranges (shift, width) of a fingerprint.
RANGES = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: A bucket beyond this many fingerprints is dealt out as pairs of chunks.
CHUNK = 2048
#: Shingles turned to bits at once, to bound the memory of very long texts.
SPAN = 1 << 16


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of UTF-8 text; 0 for a text without words."""
    words = data.lower().split()  # on bytes: A-Z only, and white space \\x20 \\x09-\\x0D only
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    joined = b" ".join(words)
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    n, digest = len(words) - width + 1, xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SPAN):
        end = min(n, at + SPAN)
        hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:end], starts[at + width : end + width], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])
    release_memory()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; one narrow pass over the whole texts, no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between class representatives from rows (bucket, fp, rep) sorted by bucket."""
    columns = lambda batch: [np.asarray(batch.column(i)) for i in range(3)]
    return bucket_edges(lambda rows: bucket_links(rows[0], rows[1]), columns, 2)(batches)


def candidate_rows(classes: DataFrame) -> DataFrame:
    """(bucket, fp, rep) for each of the ten keys of each fingerprint that shares the key with another.

    `bucket` is a 64-bit name of (table, key, chunk pair): equal keys get equal names; should two names
    ever clash, their rows are merely compared as well, which adds no false link.
    """
    part = [F.shiftrightunsigned(F.col("fp"), s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in RANGES]
    keys = [(F.lit(k) * F.lit(1 << 26)) + part[i] * F.lit(1 << 13) + part[j] for k, (i, j) in enumerate(combinations(range(5), 2))]
    rows = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("key", "k")
    dealt = rows.join(sizes, F.col("key") == F.col("k")).withColumn("g", F.ceil(F.col("n") / CHUNK))
    mine = F.pmod(F.xxhash64("fp"), F.col("g"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    pairs = dealt.withColumn("c", mine).withColumn("o", other)
    cell = F.when(F.col("g") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")))
    return pairs.select(cell.alias("bucket"), "fp", "rep")


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, fp, component_id) of every row: components of fingerprints at most three bits apart.

    Null and empty texts have fingerprint zero and link like any other; ties, repeated rows and rows that
    share an id each keep their row; an empty table gives an empty result; other columns are not read,
    so their names cannot clash. Equal fingerprints collapse to one class (map-side) before any
    comparison, so a group of copies of any size is one lane. Nothing is capped.
    """
    prints = scratch.keep(fingerprints(docs))
    classes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    rows = candidate_rows(classes).repartition("bucket").sortWithinPartitions("bucket")
    found = connected_components(rows.mapInArrow(_edges, "a long, b long"), scratch)
    named = scratch.keep(classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")))
    return join_facts(prints, named, ["fp"], "n", prints.count()).select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays; columns as they came, whatever their names.

    Here texts are alike from a Jaccard similarity of 0.8 of their five-word shingles (shingles.py, on wider
    fingerprints); the three-word shingles and three bits above belong to the query op1_simhash. Null texts
    and texts without words are alike. Rows are dropped by id and text, so of two unlike texts under one id
    both stay, of alike ones the one whose text has the smaller hash; rows equal in both stay together. A
    null id yields to any other. An empty table gives an empty result; very long texts are compared whole.
    """
    scratch = Scratch(spark, "near")
    gone = similar_groups(docs, scratch).filter("not kept").select("doc_id", "mark")
    return without(docs, gone, [text_mark(docs["text"])], scratch)
