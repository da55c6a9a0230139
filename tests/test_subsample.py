"""The subsample-normalised distance against a direct computation."""

import numpy as np
import pytest

from showerlake.operators import stats
from showerlake.plans import registry


def ks(a, b):
    at = np.concatenate([a, b])
    return max(abs((a <= x).mean() - (b <= x).mean()) for x in at)


def direct(one, two, n):
    n = int(min(len(one) / 5, len(two) / 5, n))
    total = sum(ks(x[:at], x[at:]) for x in (one, two) for at in np.linspace(0, len(x), n, dtype=int)[1:-1])
    return 2 * n * ks(one, two) / total if total else None


@pytest.mark.parametrize("n", [3, 6])
def test_subsample_normalised_distance(spark, n):
    rng, rows, want = np.random.default_rng(6), [], {}
    for g, (a, b) in {"x": (41, 57), "y": (200, 33), "few": (8, 50)}.items():
        sides = rng.normal(0, 1, a).round(2), rng.normal(0.5, 2, b).round(2)
        rows += [(g, float(v), i, s) for s, values in enumerate(sides) for i, v in enumerate(values)]
        want[g] = direct(*sides, n)
    order = rng.permutation(len(rows))
    frame = spark.createDataFrame([rows[i] for i in order], "g string, value double, row int, side int")
    got = {r["g"]: r["dissimilarity"] for r in stats.subsample_normalised(frame, "value", "side", ["row"], ["g"], stats.kolmogorov_smirnov, n).collect()}
    assert got.keys() == want.keys() and got["few"] is None and want["few"] is None
    assert all(got[g] == pytest.approx(want[g]) for g in ("x", "y"))


def test_subsample_query_gives_rows(spark):
    rows = registry.queries()["p_subsample_distance"](spark, "/root/testdata/sf0.001").collect()
    assert {r["distance"] for r in rows} == {"ks", "js", "es"} and all(r["dissimilarity"] > 0 for r in rows)
