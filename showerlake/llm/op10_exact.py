"""Exact deduplication over an extendible-hash index kept in shared files. DataFrame operations only.

The directory starts with about a slot per bucket of evenly spread keys and doubles while one overflows: a
bucket is the shortest prefix of the key's bits, from that depth on, whose keys fit its capacity. Each
scan task collapses its rows to pages; pages go to the owner task of their bucket, which holds whole
ranges of keys, merges the pages of a key and chains what the key stands for. Where several rows share a
key, length and digest, their texts come to the owner too, and each text that differs in a byte is a
link of the chain of its own: the links give the group and the row that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, is_small, join_facts, table, text_mark, without

#: Keys that a bucket holds before it splits, doublings beyond the first directory, and the deepest one (2**DEEPEST slots).
CAPACITY, DOUBLINGS, DEEPEST = 4096, 8, 40
NAME = ["key", "size", "digest"]


def _prefix(key, bits: int):
    """The leading bits of a key, marked by a leading one so that prefixes of all lengths differ."""
    return F.lit(1 << bits).cast("long") + (F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0))


def first_depth(rows: int, capacity: int = CAPACITY) -> int:
    """Depth of the directory before any split: its slots would hold about a bucket each of evenly spread keys."""
    return min(DEEPEST - DOUBLINGS, max(0, (rows // capacity).bit_length() - 1))


def directory(entries: DataFrame, start: int, capacity: int = CAPACITY, doublings: int = DOUBLINGS) -> DataFrame:
    """(slot, bucket, local_depth): the bucket of each occupied slot of the full directory of start + doublings bits.

    `entries` has one row per key. Counts of the finest slots are summed map-side; windows over the first
    directory's slots (at most 2**doublings rows each) add up siblings. A bucket stops splitting at the
    first depth from `start` on at which its keys fit; at the deepest level it may hold more.
    """
    depth = start + doublings
    fine = entries.groupBy(_prefix(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n"))
    at = lambda d: F.expr(f"shiftright(slot, {depth - d})")
    dealt = fine.withColumn("first", at(start)).repartition("first")
    bucket, local = at(depth), F.lit(depth)
    for d in range(depth - 1, start - 1, -1):
        fits = F.sum("n").over(Window.partitionBy("first", at(d))) <= capacity
        bucket, local = F.when(fits, at(d)).otherwise(bucket), F.when(fits, d).otherwise(local)
    return dealt.select("slot", bucket.alias("bucket"), local.alias("local_depth"))


def named(norm: Column) -> tuple[Column, Column, Column]:
    """What stands for a normalised text: key, length and digest."""
    return F.xxhash64(norm), F.octet_length(norm), F.unhex(F.sha2(norm, 256))


def _with_names(docs: DataFrame) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), ascii_lower(F.col("text")).alias("norm"))
    return text.select("doc_id", "mark", "norm", *(c.alias(n) for c, n in zip(named(F.col("norm")), NAME, strict=True)))


def _merged(pages: DataFrame, by: list[str]) -> DataFrame:
    """Pages of the scan tasks, dealt to the owners of whole buckets and merged there."""
    return pages.repartition("bucket").groupBy("bucket", *by).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _pages(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per scan task and value of `by`: a group of any share of the rows collapses before it travels."""
    return rows.groupBy(F.spark_partition_id().alias("page"), *by).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("page")


def build_index(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, index): the compact row table, and (bucket, key, size, digest, keep_id, group_size), sorted within whole buckets."""
    rows = scratch.keep(_with_names(docs).select("doc_id", "mark", *NAME))
    start = first_depth(rows.count())
    slots = scratch.keep(directory(rows.select("key").distinct(), start))
    placed = _pages(rows, NAME).withColumn("slot", _prefix(F.col("key"), start + DOUBLINGS)).join(F.broadcast(slots) if is_small(slots) else slots, "slot")
    return rows, scratch.keep(_merged(placed, NAME).sortWithinPartitions("bucket", "key"))


def chains(docs: DataFrame, rows: DataFrame, index: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, size, digest, norm, keep_id, group_size): a link for each different text behind an entry of several rows.

    Only the texts of such entries, known by the hash of the text as it came, are read and lower-cased
    again; they go to the owner of their bucket as pages.
    """
    several = scratch.keep(index.filter("group_size > 1").select("bucket", *NAME, "group_size"))
    marks = scratch.keep(join_facts(rows, several, NAME, "group_size", rows.count()).select(F.col("mark").alias("__mark")).distinct())
    back = docs.select("doc_id", "text").join(F.broadcast(marks) if is_small(marks) else marks, text_mark(F.col("text")) == F.col("__mark"), "left_semi")
    home = several.drop("group_size")
    texts = _with_names(back).join(F.broadcast(home) if is_small(home) else home, NAME)
    return scratch.keep(_merged(_pages(texts, ["bucket", *NAME, "norm"]), [*NAME, "norm"]).drop("bucket"))


def exact_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, mark, keep_id, group_size, kept, digest) of every row; texts equal after lower-casing A-Z are one group.

    Null counts as empty text and is a group like any other. The largest id stays; rows that share
    both id and text share the decision and all count; rows that share an id with another text are
    judged by their own. Very long texts are compared whole. An empty table gives an empty result, columns
    other than doc_id and text are not read, so their names cannot clash. Should different texts ever share
    key, length and digest, they are links of one chain and groups of their own.
    """
    rows, index = build_index(docs, scratch)
    links = chains(docs, rows, index, scratch)
    facts = links.select(*NAME, "keep_id", "group_size")
    clash = scratch.keep(links.groupBy(*NAME).agg(F.count("*").alias("links"), F.sum("group_size").alias("of")).filter("links > 1"))
    out = ["doc_id", "mark", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest"]
    total = rows.count()
    if clash.isEmpty():
        found = join_facts(rows, facts, NAME, "group_size", total, "left").select(*out)
    else:  # by the text itself, only for what the digest does not tell apart
        plain = join_facts(rows.join(clash, NAME, "left_anti"), facts.join(clash, NAME, "left_anti"), NAME, "group_size", total, "left").select(*out)
        odd = _with_names(docs).join(F.broadcast(clash.select(*NAME)) if is_small(clash) else clash.select(*NAME), NAME, "left_semi")
        found = plain.union(join_facts(odd, links, [*NAME, "norm"], "group_size", total).select(*out))
    return found.select("doc_id", "mark", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), sets AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t
)
SELECT n.doc_id, s.keep_id, s.group_size, n.doc_id = s.keep_id AS kept, sha256(n.t) AS text_sha256
FROM norm n JOIN sets s ON n.t = s.t
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; columns as they came, whatever their names.

    Null texts are one group with empty ones. Rows are dropped by id and text, so another text under the
    same id stays; rows equal in both stay together. A null id yields to any other id of its group. Ties
    cannot arise otherwise, very long texts are compared whole, and an empty table gives an empty result.
    """
    scratch = Scratch(spark, "exact")
    gone = exact_groups(docs, scratch).filter("not kept").select("doc_id", "mark")
    return without(docs, gone, [text_mark(docs["text"])], scratch)
