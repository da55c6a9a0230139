"""Clustering of one event's inputs in NumPy: what no join or window expresses, since each merge changes the distances.

A kernel takes a dict of equally long arrays (pt, rapidity, phi, energy, px, py, pz) and parameters. Ties
go to the first pair in row-major order.
"""

from __future__ import annotations

import math

import numpy as np

PI, INF = float(np.pi), float("inf")
COLUMNS = ["pt", "rapidity", "phi", "energy", "px", "py", "pz"]


def wrap(x: np.ndarray) -> np.ndarray:
    return (x + PI) % (2 * PI) - PI


def distances2(e: dict, kind: str = "angular") -> np.ndarray:
    dy = e["rapidity"][:, None] - e["rapidity"][None, :]
    dphi = np.abs(wrap(e["phi"][:, None] - e["phi"][None, :]))
    if kind == "taxicab":
        return np.abs(dy) + dphi
    dot = sum(e[c][:, None] * e[c][None, :] for c in ("px", "py", "pz"))
    energy = np.where(e["energy"] == 0, 1e-10, e["energy"])
    if kind == "normed":
        return 1 - dot / (energy[:, None] * energy[None, :])
    if kind == "invarient":
        mass2 = e["energy"].sum() ** 2 - sum(e[c].sum() ** 2 for c in ("px", "py", "pz"))
        return (e["energy"][:, None] * e["energy"][None, :] - dot) / (mass2 if mass2 > 0 else 1.0)
    return dy * dy + dphi * dphi


def width(points: list[tuple[float, float]]) -> float:
    """Largest distance of two points (linear, angle), the angles turned to their circular mean.

    Sums run in the order given, with the C library's functions, as in SQL engines: where a point lies opposite the
    mean their last digits decide on which side it falls, and numpy's and Java's functions have others.
    """
    points = [(y, a) for y, a in points if y is not None and a is not None]
    up = along = 0.0
    for _, a in points:
        up += math.sin(a)
        along += math.cos(a)
    start = math.atan2(up, along)
    turned = [(y, a - start + PI - 2 * PI * math.floor((a - start + PI) / (2 * PI)) - PI) for y, a in points]
    return max(math.sqrt((y - z) * (y - z) + (a - b) * (a - b)) for y, a in turned for z, b in turned)


def rapidity_of(energy: float, pz: float, pt: float) -> float:
    if pz == 0:
        return 0.0
    gap, mass2 = energy - abs(pz), max(energy**2 - pz**2 - pt**2, 0.0)
    if gap == 0:
        return float(np.sign(pz) * np.inf)
    return float(np.sign(pz) * 0.5 * np.log((pt**2 + mass2) / gap**2))


class Tree:
    """Pseudojets of an event: inputs first, each merge at the end."""

    def __init__(self, e: dict):
        n = len(e["pt"])
        self.rows = [{**{c: float(e[c][i]) for c in COLUMNS}, "pj_idx": i, "input_idx": i, "parent": -1, "child1": -1, "child2": -1, "rank": 0, "join_distance": 0.0, "size": 1.0} for i in range(n)]

    def merge(self, a: int, b: int, distance: float) -> int:
        one, two, new = self.rows[a], self.rows[b], len(self.rows)
        row = {c: one[c] + two[c] for c in ("energy", "px", "py", "pz", "size")}
        row["pt"], row["phi"] = float(np.hypot(row["px"], row["py"])), float(np.arctan2(row["py"], row["px"]))
        row["rapidity"] = rapidity_of(row["energy"], row["pz"], row["pt"])
        row |= {"pj_idx": new, "input_idx": -1, "parent": -1, "child1": max(a, b), "child2": min(a, b), "rank": max(one["rank"], two["rank"]) + 1, "join_distance": distance}
        one["parent"] = two["parent"] = new
        self.rows.append(row)
        return new

    def root(self, i: int) -> int:
        while self.rows[i]["parent"] >= 0:
            i = self.rows[i]["parent"]
        return i

    def jets(self) -> list[dict]:
        return [{**r, "jet": self.root(i)} for i, r in enumerate(self.rows)]


def _scalar_distance(kind: str):
    """The distance of two pseudojets as a plain function; events are small, and arrays of few numbers cost more than they save."""

    def dot(a: dict, b: dict) -> float:
        return a["px"] * b["px"] + a["py"] * b["py"] + a["pz"] * b["pz"]

    def apart(a: dict, b: dict) -> tuple[float, float]:
        return a["rapidity"] - b["rapidity"], abs((a["phi"] - b["phi"] + PI) % (2 * PI) - PI)

    def angular(a: dict, b: dict) -> float:
        dy, dphi = apart(a, b)
        return dy * dy + dphi * dphi

    def taxicab(a: dict, b: dict) -> float:
        dy, dphi = apart(a, b)
        return abs(dy) + dphi

    def normed(a: dict, b: dict) -> float:
        return 1 - dot(a, b) / ((a["energy"] or 1e-10) * (b["energy"] or 1e-10))

    def invarient(a: dict, b: dict) -> float:  # before it is divided by the mass of all
        return a["energy"] * b["energy"] - dot(a, b)

    return {"angular": angular, "taxicab": taxicab, "normed": normed, "invarient": invarient}[kind]


def _power(x: float, p: float) -> float:
    return INF if x == 0 and p < 0 else x**p


def generalised_kt(e: dict, delta_r: float = 0.8, power: float = -1.0, kind: str = "angular", pt_format: str = "min", closer2: float | None = None) -> list[dict]:
    """Sequential merging: power -1 anti-kt, 0 Cambridge/Aachen, 1 kt; a pseudojet nearest to the beam becomes a jet.

    Each pseudojet keeps its nearest partner of higher number, so a merge computes one row of distances and
    looks again only for the partners that went: a square of the inputs in all, but for ties.
    With `closer2`, the square of delta_r as written, a pair that has the beam's weight merges only if its squared
    distance is below that: neither a tie nor the rounding of a weighted distance decides (`min`, not `invarient`).
    """
    if closer2 is not None and (pt_format != "min" or kind == "invarient"):
        raise ValueError("closer2 needs the weight min and a distance without scale")
    tree, between, p = Tree(e), _scalar_distance(kind), 2 * power
    rows, alive = tree.rows, list(range(len(e["pt"])))
    pairs: list[dict[int, float]] = []
    weight: list[float] = []
    least: list[float] = []
    partner: list[int] = []

    def distance(i: int, j: int) -> float:
        if pt_format == "min":
            factor = min(weight[i], weight[j])
        else:
            one, two = rows[i]["pt"], rows[j]["pt"]
            factor = _power(one * two, p) * _power(one + two, -p)
        found = between(rows[i], rows[j]) * factor
        return 0.0 if found != found else found

    def look(i: int) -> None:
        """The nearest of the pseudojets after i, the first of several."""
        own = pairs[i]
        partner[i] = min((j for j in alive if j > i), key=own.__getitem__, default=-1)
        least[i] = own[partner[i]] if partner[i] >= 0 else INF

    for row in rows:
        weight.append(_power(row["pt"], p))
        least.append(INF)
        partner.append(-1)
        pairs.append({})
    for i in alive:
        pairs[i] = {j: distance(i, j) for j in alive if j > i}
        look(i)
    while alive:
        scale = 1.0
        if kind == "invarient":
            total = [sum(rows[i][c] for i in alive) for c in ("energy", "px", "py", "pz")]
            scale = total[0] ** 2 - total[1] ** 2 - total[2] ** 2 - total[3] ** 2
            scale = scale if scale > 0 else 1.0
        i, k = min(alive, key=least.__getitem__), min(alive, key=weight.__getitem__)
        nearest, beam = least[i] / scale, delta_r**2 * weight[k]
        merges = nearest < beam or (nearest == beam < INF and i < k)
        if closer2 is not None and partner[i] >= 0 and min(weight[i], weight[partner[i]]) == weight[k]:
            merges = between(rows[i], rows[partner[i]]) < closer2
        if merges:
            gone = (i, partner[i])
            made = tree.merge(*gone, max(nearest, 0.0) ** 0.5)
        else:
            gone, made = (k,), -1
        for x in gone:
            alive.remove(x)
        for x in alive:
            if partner[x] in gone:
                look(x)
        if made >= 0:
            weight.append(_power(rows[made]["pt"], p))
            least.append(INF)
            partner.append(-1)
            pairs.append({})
            for x in alive:
                d = pairs[x][made] = distance(x, made)
                if d < least[x]:
                    least[x], partner[x] = d, made
            alive.append(made)
    return tree.jets()


def iterative_cone(e: dict, delta_r: float = 0.8, seed: float = 1.0, passes: int = 1) -> np.ndarray:
    """Jet label per input: cones around the hardest input left; inputs outside every cone get labels of their own."""
    n = len(e["pt"])
    label, jet = np.full(n, -1), 0
    while (free := np.flatnonzero(label < 0)).size:
        top = free[e["pt"][free].argmax()]
        if e["pt"][top] <= seed:
            break
        phi, y = e["phi"][top], e["rapidity"][top]
        for _ in range(passes):
            inside = free[wrap(e["phi"][free] - phi) ** 2 + (e["rapidity"][free] - y) ** 2 < delta_r**2]
            px, py, pz, en = (e[c][inside].sum() for c in ("px", "py", "pz", "energy"))
            phi, y = np.arctan2(py, px), rapidity_of(en, pz, np.hypot(px, py))
        label[inside if inside.size else top] = jet
        jet += 1
    for i in np.flatnonzero(label < 0):
        label[i], jet = jet, jet + 1
    return label


def affinity(d2: np.ndarray, kind: str, exponent: float, sigma: float, neighbours: int | None) -> np.ndarray:
    with np.errstate(divide="ignore"):
        if kind == "exponent":
            a = np.exp(-(np.maximum(d2, 0) ** (exponent / 2)) / sigma)
        elif kind == "linear":
            a = -np.sqrt(d2)
            a -= a.min(initial=0)
        else:
            a = np.sqrt(d2) ** -1.0
            a[np.isinf(a)] = a[np.isfinite(a)].max(initial=1) * 2
    if neighbours is not None and neighbours < len(d2):
        near = d2.argsort(axis=0, kind="stable").argsort(axis=0, kind="stable") <= neighbours
        a = np.where(near | near.T, a, 0)
    np.fill_diagonal(a, 0)
    return a


def embedding(e: dict, dimensions: int = 3, kind: str = "exponent", exponent: float = 2.0, sigma: float = 1.0, neighbours: int | None = None, laplacian: str = "symmetric") -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, coordinates) of the graph Laplacian without its trivial vector; signs fixed by the largest entry."""
    a = affinity(distances2(e), kind, exponent, sigma, neighbours)
    degree = a.sum(1)
    size = {"unnormalised": np.ones(len(a)), "symmetric": degree, "pt": e["pt"], "energy": e["energy"]}[laplacian]
    root = np.where(size > 0, np.maximum(size, 1e-30) ** -0.5, 0)
    values, vectors = np.linalg.eigh(root[:, None] * (np.diag(degree) - a) * root[None, :])
    values, vectors = values[1 : dimensions + 1], vectors[:, 1 : dimensions + 1]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if vectors.size else 1
    return values, vectors * np.where(sign == 0, 1, sign)


def _labels(groups: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, int)
    for k, g in enumerate(sorted(groups, key=min)):
        out[g] = k
    return out


def eigen_distance(x: np.ndarray, y: np.ndarray, kind: str = "euclidien") -> np.ndarray:
    """Distances of points in eigenspace: straight, the angle between them, or the angle whose cosine counts from its far side."""
    if kind == "euclidien":
        return np.sqrt(((x[:, None] - y[None, :]) ** 2).sum(-1))
    size = np.maximum(np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :], 1e-300)
    cosine = np.clip(x @ y.T / size, -1, 1)
    if kind == "spherical":
        return np.arccos(cosine)
    if kind == "abscos":
        return np.arccos(np.clip(1 - np.abs(1 - cosine), -1, 1))
    raise ValueError(f"no such distance: {kind}")


def conductance(links: np.ndarray, sizes: np.ndarray, inside: list[int]) -> float:
    """Affinity that leaves a group over the size of the group (or of everything, if that is less)."""
    outside = np.setdiff1d(np.arange(len(links)), inside)
    size = min(sizes[inside].sum(), sizes.sum())
    return float(links[np.ix_(inside, outside)].sum() / size) if size > 0 else float("inf")


def spectral(e: dict, delta_r: float = 0.5, stop: str = "mean", refresh: bool = False, eigen: str = "euclidien", **settings) -> np.ndarray:
    """Agglomeration in the eigenspace; merged points sit at their mean, or are embedded anew with `refresh`.

    stop: `mean` ends when the mean distance exceeds delta_r, `standard` when the least one does.
    `beamparticle` has a point more, of ones, and a group nearest to it becomes a jet. `conductance` makes a
    jet of each group of a pair that holds together better than their merger would.
    """
    if stop not in ("mean", "standard", "beamparticle", "conductance"):
        raise ValueError(f"no such stop: {stop}")
    n = len(e["pt"])
    groups, jets = [[i] for i in range(n)], []
    if n < 3:
        return np.arange(n)
    now = {c: e[c].copy() for c in COLUMNS}
    _, x = embedding(now, **settings)
    if stop == "conductance":
        links = affinity(distances2(e), settings.get("kind", "exponent"), settings.get("exponent", 2.0), settings.get("sigma", 1.0), settings.get("neighbours"))
        sizes = {"unnormalised": np.ones(n), "symmetric": links.sum(1), "pt": e["pt"], "energy": e["energy"]}[settings.get("laplacian", "symmetric")]
        held = [conductance(links, sizes, g) for g in groups]

    def leave(k: int) -> None:
        nonlocal x, now
        jets.append(groups.pop(k))
        x, now = np.delete(x, k, 0), {c: np.delete(v, k) for c, v in now.items()}

    while len(groups) > 1:
        d = eigen_distance(x, x, eigen)
        off = d[np.triu_indices(len(groups), 1)]
        if stop in ("mean", "standard") and (off.mean() if stop == "mean" else off.min()) > delta_r:
            break
        np.fill_diagonal(d, np.inf)
        if stop == "beamparticle":
            beam = eigen_distance(x, np.ones((1, x.shape[1])), eigen)[:, 0]
            if beam.min() < off.min():
                leave(int(beam.argmin()))
                continue
        i, j = sorted(divmod(int(d.argmin()), len(groups)))
        if stop == "conductance":
            together = conductance(links, sizes, groups[i] + groups[j])
            firm = [k for k in (j, i) if held[k] < together]
            for k in firm:
                leave(k)
                held.pop(k)
            if firm:
                continue
            held[i] = together
            held.pop(j)
        groups[i] += groups.pop(j)
        for c in ("energy", "px", "py", "pz"):
            now[c][i] += now[c][j]
        now = {c: np.delete(v, j) for c, v in now.items()}
        now["pt"][i], now["phi"][i] = np.hypot(now["px"][i], now["py"][i]), np.arctan2(now["py"][i], now["px"][i])
        now["rapidity"][i] = rapidity_of(now["energy"][i], now["pz"][i], now["pt"][i])
        if refresh and len(groups) > 2:
            _, x = embedding(now, **settings)
        else:
            x[i] = (x[i] + x[j]) / 2
            x = np.delete(x, j, 0)
    return _labels(jets + groups, n)


def indicator(e: dict, base_jump: float = 0.05, eigen_factor: float = 0.1, **settings) -> np.ndarray:
    """Inputs with equal cells in every eigenvector, cut where sorted values jump."""
    n = len(e["pt"])
    if n < 3:
        return np.arange(n)
    values, x = embedding(e, **settings)
    cells = np.zeros((n, x.shape[1]), int)
    for k in range(x.shape[1]):
        order = x[:, k].argsort(kind="stable")
        cells[order, k] = np.r_[0, np.cumsum(np.diff(x[order, k]) > base_jump + values[k] * eigen_factor)]
    _, at = np.unique(cells, axis=0, return_inverse=True)
    return _labels([np.flatnonzero(at == k).tolist() for k in range(at.max() + 1)], n)


def splitting(e: dict, max_cut: float = 0.3, **settings) -> np.ndarray:
    """Cut off the best prefix or suffix in the order of the last eigenvector while its cut score is low; the rest is one group."""
    n = len(e["pt"])
    if n < 3:
        return np.arange(n)
    _, x = embedding(e, **settings)
    a = affinity(distances2(e), settings.get("kind", "exponent"), settings.get("exponent", 2.0), settings.get("sigma", 1.0), settings.get("neighbours"))
    left, groups = x[:, -1].argsort(kind="stable").tolist(), []
    while len(left) > 1:
        options = []
        for k in range(1, len(left)):
            inside, outside = left[:k], left[k:]
            cut = a[np.ix_(inside, outside)].sum()
            weight = min(a[inside].sum(), a[outside].sum())
            options.append((cut / weight if weight > 0 else 0.0, k))
        score, k = min(options)
        if score >= max_cut:
            break
        piece = left[:k] if k <= len(left) - k else left[k:]
        groups.append(piece)
        left = [i for i in left if i not in piece]
    if left:
        groups.append(left)
    return _labels(groups, n)


def spectral_kmeans(e: dict, clusters: int = 2, restarts: int = 12, seed: int = 5, rounds: int = 12, recur: int = 5, most: int = 500, **settings) -> np.ndarray:
    """k-means on the eigenspace with arccos(|cos|) distance, started anew until the best score has recurred.

    Starts are seeded and move together, `restarts` at a time, until the best sum of distances has come up more
    than `recur` times, or `most` starts are spent; the first best one counts.
    """
    n = len(e["pt"])
    if n < 3 or n <= clusters:
        return np.arange(n)
    _, x = embedding(e, dimensions=clusters, **settings)
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    rng, best, times, at, spent = np.random.default_rng(seed), np.inf, 0, np.zeros(n, int), 0
    while times <= recur and spent < most:
        centres = x[np.argsort(rng.random((restarts, n)), axis=1)[:, :clusters]]
        for _ in range(rounds):
            cosine = np.abs(x @ centres.transpose(0, 2, 1))
            owner = cosine.argmax(2)
            mine = (owner[:, :, None] == np.arange(clusters)).astype(float)
            sums = mine.transpose(0, 2, 1) @ x
            size = np.sqrt((sums * sums).sum(2, keepdims=True))
            new = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
            if np.array_equal(new, centres):
                break
            centres = new
        scores = np.arccos(np.clip(cosine.max(2), 0, 1)).sum(1).round(9)
        if scores.min() < best:
            best, times, at = scores.min(), 0, owner[scores.argmin()]
        times, spent = times + int((scores == best).sum()), spent + restarts
    return _labels([np.flatnonzero(at == k).tolist() for k in range(clusters) if (at == k).any()], n)


KERNELS = {"iterative_cone": iterative_cone, "spectral": spectral, "indicator": indicator, "splitting": splitting, "spectral_kmeans": spectral_kmeans}


SHAPES = ["thrust", "sphericity", "aplanarity", "c", "d", "spherocity", "transverse_thrust", "major", "minor", "oblateness", "planarity", "acoplanarity", "light_mass2", "heavy_mass2", "difference_mass2"]


def _transverse_axis(p: np.ndarray) -> np.ndarray:
    """Unit vector in the plane along the largest sum of momenta that are each signed by the side of a line; p is n x 2."""
    best = p.sum(0)
    for i in np.flatnonzero(np.hypot(p[:, 0], p[:, 1]) > 0):
        off, ahead = p[i, 0] * p[:, 1] - p[i, 1] * p[:, 0], np.sign(p @ p[i])
        for turn in (1, -1):  # momenta along the line itself stand on either side of it
            v = (np.where(off == 0, turn * ahead, np.sign(off))[:, None] * p).sum(0)
            if np.hypot(*v) > np.hypot(*best) * (1 + 1e-12):
                best = v
    return best / (np.hypot(*best) or 1)


def _major_axis(weights: np.ndarray, thrust: np.ndarray) -> np.ndarray:
    """Unit vector at right angles to thrust with the largest sum of weights times its absolute components."""
    best = np.zeros(3)
    for signs in ((1, 1, 1), (1, 1, -1), (1, -1, 1), (1, -1, -1)):
        v = weights * signs
        v = v - (v @ thrust) * thrust
        if v @ v > best @ best * (1 + 1e-12):
            best = v
    return best / (np.linalg.norm(best) or 1)


def event_shape(p: np.ndarray, energy: np.ndarray | None = None) -> dict[str, float]:
    """The SHAPES: thrust by exact enumeration of hemispheres, the others from its axis and the momentum tensors; p is n x 3.

    As in the reference, the major axis and acoplanarity weigh the sums of absolute components, and the
    masses are sums of squares on either side of the transverse thrust axis. Without energies they are those
    of massless particles.
    """
    norm = np.linalg.norm(p, axis=1)
    total = norm.sum()
    if total == 0:
        return dict.fromkeys(SHAPES, 0.0)
    tensor = p.T @ p / (norm**2).sum()
    l1, l2, l3 = np.sort(np.linalg.eigvalsh(tensor))[::-1]
    linear = (p[:, :, None] * p[:, None, :] / np.maximum(norm, 1e-300)[:, None, None]).sum(0) / total
    m1, m2, m3 = np.sort(np.linalg.eigvalsh(linear))[::-1]
    # the best axis separates two momenta's planes: take the sum of signed momenta for each such plane
    best = max(norm.max(), float(np.linalg.norm(p.sum(0))))
    axis = p[norm.argmax()] if best == norm.max() else p.sum(0)
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            side = p @ np.cross(p[i], p[j]) > 0
            for si in (1, -1):
                for sj in (1, -1):
                    s = np.where(side, 1.0, -1.0)
                    s[i], s[j] = si, sj
                    v = (s[:, None] * p).sum(0)
                    if (size := float(np.linalg.norm(v))) > best:
                        best, axis = size, v
    pt = np.hypot(p[:, 0], p[:, 1])
    spher = 0.0
    if pt.sum() > 0:
        units = p[pt > 0, :2] / pt[pt > 0, None]
        spher = (PI / 2) ** 2 * min((np.abs(p[:, 0] * u[1] - p[:, 1] * u[0]).sum() / pt.sum()) ** 2 for u in units)
    found = {"thrust": best / total, "sphericity": 1.5 * (l2 + l3), "aplanarity": 1.5 * l3, "c": 3 * (m1 * m2 + m2 * m3 + m3 * m1), "d": 27 * m1 * m2 * m3, "spherocity": float(spher)}
    axis, across, sums = axis / np.linalg.norm(axis), _transverse_axis(p[:, :2]), np.abs(p).sum(0)
    major = _major_axis(sums, axis)
    wide, thin = float(np.abs(p @ major).sum() / total), float(np.abs(p @ np.cross(major, axis)).sum() / total)
    upper, mass2 = p[:, :2] @ across > 0, (norm if energy is None else energy) ** 2 - norm**2
    light, heavy = sorted((float(mass2[upper].sum()), float(mass2[~upper].sum())))
    found |= {"transverse_thrust": float(np.abs(p[:, :2] @ across).sum() / pt.sum()) if pt.sum() > 0 else 0.0, "major": wide, "minor": thin, "oblateness": wide - thin, "planarity": float(l2 - l3)}
    return found | {"acoplanarity": 4 * float(sums.min()) / total, "light_mass2": light, "heavy_mass2": heavy, "difference_mass2": heavy - light}
