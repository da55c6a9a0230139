"""Sequential merging against a plain version, and the stops and distances of spectral clustering."""

import math

import numpy as np
import pytest

from showerlake.operators import kernels


def event(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    pt, phi, y = rng.exponential(10, n), rng.uniform(-np.pi, np.pi, n) * spread, rng.normal(size=n) * spread
    if n > 3 and seed % 3 == 0:
        phi[1], y[1], pt[2] = phi[0], y[0], 0.0  # a tie and an input without transverse momentum
    mt = np.hypot(pt, 0.1)
    return dict(pt=pt, rapidity=y, phi=phi, px=pt * np.cos(phi), py=pt * np.sin(phi), pz=mt * np.sinh(y), energy=mt * np.cosh(y))


def plain_kt(e, delta_r, power):
    """All distances anew for each step."""
    tree, active = kernels.Tree(e), list(range(len(e["pt"])))
    weight = lambda i: math.inf if tree.rows[i]["pt"] == 0 and power < 0 else tree.rows[i]["pt"] ** (2 * power)
    while active:
        best = None
        for i in active:
            for j in active:
                if i == j:
                    d = delta_r**2 * weight(i)
                else:
                    a, b = tree.rows[i], tree.rows[j]
                    dphi = abs((a["phi"] - b["phi"] + np.pi) % (2 * np.pi) - np.pi)
                    d = ((a["rapidity"] - b["rapidity"]) * (a["rapidity"] - b["rapidity"]) + dphi * dphi) * min(weight(i), weight(j))
                    d = 0.0 if math.isnan(d) else d
                if best is None or d < best[0]:
                    best = (d, i, j)
        d, i, j = best
        active.remove(i)
        if i != j:
            active.remove(j)
            active.append(tree.merge(i, j, math.sqrt(max(d, 0))))
    return [(r["jet"], r["child1"], r["child2"]) for r in tree.jets()]


@pytest.mark.parametrize("power", [-1.0, 0.0, 1.0])
def test_merging_equals_the_plain_version(power):
    for seed in range(25):
        e = event(1 + seed % 13, seed)
        got = [(r["jet"], r["child1"], r["child2"]) for r in kernels.generalised_kt(e, 0.8, power)]
        assert got == plain_kt(e, 0.8, power)


def two_bunches():
    e = event(10, 4, 0.03)
    e["phi"] = e["phi"] + np.repeat([0.0, 2.5], 5)
    e["rapidity"] = e["rapidity"] + np.repeat([0.0, 1.5], 5)
    return e


def test_eigenspace_distances():
    x, y = np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([[0.0, 1.0], [-3.0, 0.0]])
    assert np.allclose(kernels.eigen_distance(x, y), [[math.sqrt(2), 4], [1, math.sqrt(13)]])
    assert np.allclose(kernels.eigen_distance(x, y, "spherical"), [[np.pi / 2, np.pi], [0, np.pi / 2]])
    assert np.allclose(kernels.eigen_distance(x, y, "abscos"), [[np.pi / 2, np.pi], [0, np.pi / 2]])
    with pytest.raises(ValueError, match="distance"):
        kernels.eigen_distance(x, y, "other")


def test_conductance_of_groups():
    links = np.array([[0, 4, 1, 0], [4, 0, 0, 1], [1, 0, 0, 4], [0, 1, 4, 0]], float)
    sizes = links.sum(1)
    assert kernels.conductance(links, sizes, [0, 1]) == pytest.approx(2 / 10)
    assert kernels.conductance(links, sizes, [0]) == pytest.approx(1.0)
    assert kernels.conductance(links, sizes, [0, 1, 2, 3]) == 0.0


def test_spectral_stops():
    e = two_bunches()
    whole = [0] * 5 + [1] * 5
    assert kernels.spectral(e, stop="conductance").tolist() in (whole, [0] * 10)
    for stop in ("mean", "standard", "beamparticle", "conductance"):
        got = kernels.spectral(e, stop=stop)
        assert len(got) == 10 and got[0] == 0 and set(got.tolist()) == set(range(got.max() + 1))
        assert kernels.spectral({c: v[:2] for c, v in e.items()}, stop=stop).tolist() == [0, 1]
    with pytest.raises(ValueError, match="stop"):
        kernels.spectral(e, stop="other")


def test_k_means_separates_two_bunches_and_repeats():
    e = two_bunches()
    one, two = kernels.spectral_kmeans(e, clusters=2), kernels.spectral_kmeans(e, clusters=2, restarts=40)
    assert one.tolist() == two.tolist() and len(set(one.tolist())) == 2
