"""Small decision and regression trees on the driver, for bounded training tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, cuts: int = 32) -> Node:
    """Tree of least squares; a row goes low when its feature is <= cut. Ties take the first feature, the lowest cut."""
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return node
    best, total, n = 1e-12, y.sum(), len(y)
    for f in range(x.shape[1]):
        column = x[:, f]
        values = np.unique(column)
        if len(values) < 2:
            continue
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) > cuts:
            middles = np.unique(np.quantile(column, np.linspace(0, 1, cuts + 2)[1:-1]))
        order = np.argsort(column, kind="stable")
        sums, ranked = np.cumsum(y[order]), column[order]
        at = np.searchsorted(ranked, middles, side="right")
        ok = (at >= least) & (at <= n - least)
        if not ok.any():
            continue
        at, middles = at[ok], middles[ok]
        left = sums[at - 1]
        gain = left**2 / at + (total - left) ** 2 / (n - at) - total**2 / n
        k = int(gain.argmax())
        if gain[k] > best * (1 + 1e-9):
            best, node.feature, node.cut = float(gain[k]), f, float(middles[k])
    if node.feature < 0:
        return node
    low = x[:, node.feature] <= node.cut
    node.low, node.high = grow(x[low], y[low], depth - 1, least, cuts), grow(x[~low], y[~low], depth - 1, least, cuts)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.cut
    out = np.empty(len(x))
    out[low], out[~low] = predict(node.low, x[low]), predict(node.high, x[~low])
    return out


def paths(node: Node, above: tuple = ()) -> list[tuple[tuple[int, bool, float], ...]]:
    """Conjunctions (feature, is_low, cut) of every node below the root."""
    if node.feature < 0:
        return []
    out = []
    for is_low, child in ((True, node.low), (False, node.high)):
        here = (*above, (node.feature, is_low, node.cut))
        out += [here, *paths(child, here)]
    return out
