"""The near-duplicate stage of the pipeline against brute force on five-word shingles."""

import random

from showerlake.llm import op01_simhash
from showerlake.llm.common import Scratch
from showerlake.llm.shingles import similar_groups


def jaccard(a: str, b: str) -> float:
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def corpus():
    rng, rows = random.Random(3), []
    for base in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([30, 80, 200]))]
        rows.append(" ".join(words))
        for edits in range(1, 7):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"x{base}{edits}{at}"
            rows.append(" ".join(copy))
    return list(enumerate(rows + ["two words", "Two  words", "two other", None, "", " "]))


def brute(rows):
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a or "", b or "") >= 0.8:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i, _ in rows}


def test_near_dedup_stage_finds_similarity_of_0_8(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in similar_groups(docs, Scratch(spark, "t")).collect()} == want
    assert {r["doc_id"] for r in op01_simhash.stage(spark, docs, "").collect()} == set(want.values())
    assert similar_groups(docs.limit(0), Scratch(spark, "t")).count() == 0
