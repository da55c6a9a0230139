"""The pipeline against its stages done by hand on a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from showerlake.llm import op01_simhash, op07_mixing  # noqa: E402
from showerlake.llm.common import Scratch  # noqa: E402


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    vocabulary = {"en": "the thing which with would there", "de": "der nicht sein schon über gegen"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(vocabulary[g].split()) + str(rng.randrange(30)) for _ in range(60)), g, f"s{i % 2}") for i in range(120) for g in [list(vocabulary)[i % 2]]]
    rows += [(500, rows[0][1].upper(), "en", "s0"), (501, None, "en", "s0"), (502, "123", "en", "s1"), (503, "", None, None)]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "encoding":
            assert docs.columns == frame.columns
        sizes.append(docs.count())
        if name == "exact_dedup":
            assert 0 not in {r["doc_id"] for r in docs.collect()} and 500 in {r["doc_id"] for r in docs.collect()}
        if name == "near_dedup":
            found = op01_simhash.near_duplicates(before, Scratch(spark, "t")).collect()
            assert {r["doc_id"] for r in docs.collect()} == {r["component_id"] for r in found}
        if name == "mixing":
            kept = op07_mixing.mix(before, Scratch(spark, "t")).filter("kept").collect()
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in kept}
    assert sizes[0] == 121 and sizes[1] == 120 and sizes[3] == sizes[4] > 40
    assert sorted(tuple(r)[:2] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(tuple(r)[:2] for r in docs.collect())


def test_each_stage_begins_with_released_heaps(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        before = whole()
        stage(spark, empty, "")
        assert whole() >= before + 2, name  # the driver's and, from tasks, the executors' (here the same)
