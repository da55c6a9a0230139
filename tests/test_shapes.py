"""The event shapes against a scan of the angles."""

import numpy as np
import pytest

from showerlake.operators import kernels


def test_all_shapes_against_a_scan_of_angles():
    rng = np.random.default_rng(8)
    turn = np.linspace(0, np.pi, 20001)
    for n in (2, 3, 7):
        p = rng.normal(0, 3, (n, 3))
        energy, norm = np.sqrt((p * p).sum(1) + rng.random(n)), np.linalg.norm(p, axis=1)
        got = kernels.event_shape(p, energy)
        flat = np.c_[np.cos(turn), np.sin(turn)]
        sums = np.abs(p[:, :2] @ flat.T).sum(0)
        assert got["transverse_thrust"] == pytest.approx(sums.max() / np.hypot(p[:, 0], p[:, 1]).sum(), rel=1e-5)
        upper = p[:, :2] @ flat[sums.argmax()] > 0
        masses = sorted((energy**2 - norm**2)[side].sum() for side in (upper, ~upper))
        assert [got["light_mass2"], got["heavy_mass2"], got["difference_mass2"]] == pytest.approx([*masses, masses[1] - masses[0]])
        signs = np.array(np.meshgrid(*[[1, -1]] * n)).reshape(n, -1).T
        axes = signs @ p
        thrust = max(axes, key=np.linalg.norm)
        thrust = thrust / np.linalg.norm(thrust)
        one = np.cross([0, 0, 1], thrust)
        one /= np.linalg.norm(one)
        around = np.cos(turn)[:, None] * one + np.sin(turn)[:, None] * np.cross(one, thrust)
        major = around[(np.abs(around) @ np.abs(p).sum(0)).argmax()]
        minor = np.cross(major, thrust)
        wide, thin = (np.abs(p @ a).sum() / norm.sum() for a in (major, minor))
        assert [got["major"], got["minor"], got["oblateness"]] == pytest.approx([wide, thin, wide - thin], abs=1e-3)
        values = np.linalg.eigvalsh(p.T @ p)
        assert got["planarity"] == pytest.approx((values[1] - values[0]) / values.sum())
        assert got["acoplanarity"] == pytest.approx(4 * np.abs(p).sum(0).min() / norm.sum())
