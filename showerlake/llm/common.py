"""Helpers shared by the corpus operators: tables, the shared folder, cutting lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. One is made only where the session has none and runs on this machine alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="showerlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


class Scratch:
    """Parquet tables in the shared folder; they survive lost executors and cut lineage."""

    #: Folders that sweep() has not deleted yet.
    open_: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        Scratch.open_.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by keep() that nothing will read again."""
        self._delete(df._scratch_path)


def sweep(*spared: Scratch) -> None:
    """Delete the tables of all operators but those spared, for a caller that has stored what they returned."""
    for scratch in [s for s in Scratch.open_ if s not in spared]:
        scratch._delete(scratch.root)
        Scratch.open_.remove(scratch)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a function makes of a batch stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def release_memory() -> None:
    """Give freed memory back to the system: idle Python workers stay alive beside the next stage's tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def release_heaps(spark: SparkSession) -> None:
    """Collect garbage on the driver and the executors, whose heaps then shrink to a few times what is in use.

    A heap keeps the size that the busiest stage gave it, beside the Python workers of the next. One task for each
    core reaches every executor that has its cores free; one that is missed merely keeps its heap.
    """
    gc.collect()  # frames that Python no longer holds let go of their broadcasts
    spark._jvm.System.gc()
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).collect()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def text_mark(text: Column) -> Column:
    """Tells rows that share an id apart by their texts as they came; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fold_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`: the fixed held-out folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def unit_hash(seed: int, *cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


#: Rows up to which a counted table is broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 500_000
#: A group with more than this share of the rows (and more than LEAST_HOT of them) is joined by broadcast: there are fewer than 1/HOT such groups.
HOT, LEAST_HOT = 1 / 4000, 256


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until the frame has no column of the name."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def is_small(held: DataFrame, most: int | None = None) -> bool:
    most = MOST_BROADCAST if most is None else most
    return held.limit(most + 1).count() <= most


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to `facts`, one per key, of which `size` is the number of rows that have the key.

    `how` is inner or left. Few facts are broadcast as they are. Else rows of hot keys (fewer than 1/HOT keys
    can be hot) meet their facts by broadcast, and only the others are shuffled, so no task gets a hot key.
    """
    if is_small(facts):
        return rows.join(F.broadcast(facts), on, how)
    hot = F.col(size) > max(LEAST_HOT, int(total * HOT))
    heavy = F.broadcast(facts.filter(hot))
    light = rows.join(heavy.select(*on), on, "left_anti").join(facts.filter(~hot), on, how)
    return rows.join(heavy, on).select(*light.columns).union(light)


def without(docs: DataFrame, gone: DataFrame, marks: list[Column], scratch: Scratch) -> DataFrame:
    """The rows of `docs` that are not in `gone`; columns as they came.

    `gone` has an id and, one for one, the values of `marks` on docs: rows that share their id with another
    text are told apart by them. A null id equals a null id.
    """
    names = fresh(docs, *(f"gone{i}" for i in range(1 + len(marks))))
    held = scratch.keep(gone.toDF(*names).distinct())
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(names[0]))
    for name, mark in zip(names[1:], marks, strict=True):
        same = same & (mark == F.col(name))
    return docs.join(F.broadcast(held) if is_small(held) else held, same, "left_anti")
