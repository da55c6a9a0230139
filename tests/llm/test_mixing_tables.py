"""Raking as tables and on the driver must agree where margins are correlated and rounds many."""

import random

import pytest

from showerlake.llm import op07_mixing
from showerlake.llm.common import Scratch


@pytest.mark.filterwarnings("ignore:mixing has not converged")
def test_tables_rake_as_far_as_the_driver(spark):
    rng, rows = random.Random(2), []
    for source in range(24):
        main = source % 4
        for lang in range(4):
            for topic in ("prose", "short"):
                if lang == main or rng.random() < 0.4:
                    rows.append((f"s{source}", f"l{lang}", topic, int(10 ** rng.uniform(1, 3)) * (50 if lang == main else 1)))
    frame = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = [{f"s{i}": 1.0 for i in range(24)}, {"l0": 0.4, "l1": 0.3, "l2": 0.2, "l3": 0.1}, {"prose": 0.5, "short": 0.5}]
    found = []
    for most in (op07_mixing.MOST_CELLS, 2):
        cells, small = op07_mixing.cell_probabilities(frame, Scratch(spark, "t"), targets, most)
        assert small == (most > 2)
        found.append({tuple(r)[:3]: (r["weight"], r["prob"]) for r in cells.collect()})
    assert found[0].keys() == found[1].keys()
    for key, (weight, prob) in found[0].items():
        assert found[1][key] == (pytest.approx(weight, rel=1e-6), pytest.approx(prob, rel=1e-6))
