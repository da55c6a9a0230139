"""The document pipeline: five stages, each one operator of showerlake.llm on all that its predecessor kept.

run() works documents through the stages; each result is written to the shared folder and read again as
the next stage's input, so lineage is cut and a lost executor repeats part of one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from showerlake.llm import op01_simhash, op04_bpe, op07_mixing, op09_language, op10_exact
from showerlake.llm.common import Scratch, release_heaps, sweep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _lean(stage: Stage) -> Stage:
    """The stage, begun with the heaps that the one before it needed given back."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language", _lean(op09_language.stage)),
    ("exact_dedup", _lean(op10_exact.stage)),
    ("near_dedup", _lean(op01_simhash.stage)),
    ("mixing", _lean(op07_mixing.stage)),
    ("encoding", _lean(op04_bpe.stage)),
]

#: SQL cannot express the trained stages; tests/llm/test_round_trips.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's own tables go once its result is stored; null, empty and very long texts,
    repeated rows and ids, empty tables and further columns are handled as the stages say."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        others = list(Scratch.open_)
        docs, last = scratch.keep(stage(spark, docs, sf_dir)), before
        sweep(*others)
        before = docs
        if last is not None:
            scratch.drop(last)
    return docs
