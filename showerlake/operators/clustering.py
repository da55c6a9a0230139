"""Running event kernels over a partitioned table: sorted by event, whole events per call, one Python pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

TREE_SCHEMA = "event_id long, jet int, pj_idx int, input_idx int, parent int, child1 int, child2 int, rank int, pt double, rapidity double, phi double, energy double, px double, py double, pz double, join_distance double, size double"


def per_group(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], kernel: Callable[[dict], dict], schema: str) -> DataFrame:
    """Apply `kernel` (arrays of one group -> arrays of its result) to each group.

    Cheaper than one call of the engine per group: a partition is sorted by its keys and streamed in Arrow
    batches; only the unfinished last group is carried over. A group must fit in a task, which events do.
    """
    types = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def emit(block: dict[str, np.ndarray]) -> pa.RecordBatch:
            n = len(block[keys[0]])
            new = np.zeros(n, bool)
            new[:1] = True
            for k in keys:
                new[1:] |= block[k][1:] != block[k][:-1]
            cuts = [*np.flatnonzero(new).tolist(), n]
            out: dict[str, list] = {name: [] for name, _ in types}
            for a, b in zip(cuts, cuts[1:]):
                found = kernel({c: v[a:b] for c, v in block.items()})
                for name, _ in types:
                    out[name].append(np.asarray(found[name]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[name]) if out[name] else [], arrow[kind]) for name, kind in types], [name for name, _ in types])

        for batch in batches:
            block = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate([*keys, *columns])}
            if held is not None:
                block = {c: np.concatenate([held[c], v]) for c, v in block.items()}
            n = len(block[keys[0]])
            if not n:
                continue
            same = np.ones(n, bool)
            for k in keys:
                same &= block[k] == block[k][-1]
            cut = n - int(same.sum())
            if cut:
                yield emit({c: v[:cut] for c, v in block.items()})
            held = {c: v[cut:] for c, v in block.items()}
        if held is not None and len(held[keys[0]]):
            yield emit(held)

    return rows.select(*keys, *columns, *[o for o in order if o not in columns and o not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns).mapInArrow(run, schema)


def generalised_kt(inputs: DataFrame, delta_r: float = 0.8, power: float = -1.0, kind: str = "angular", pt_format: str = "min", closer2: float | None = None) -> DataFrame:
    """Pseudojet trees of every event; `jet` is the root's index. The settings are those of kernels.generalised_kt."""

    def kernel(e: dict) -> dict:
        found = kernels.generalised_kt(e, delta_r, power, kind, pt_format, closer2)
        return {"event_id": np.full(len(found), e["event_id"][0])} | {c: np.array([r[c] for r in found]) for c in found[0]}

    return per_group(inputs, ["event_id"], ["input_idx"], kernels.COLUMNS, kernel, TREE_SCHEMA)


def labelled(inputs: DataFrame, name: str, **settings) -> DataFrame:
    """(event_id, input_idx, jet) by a registered kernel."""
    kernel_ = kernels.KERNELS[name]

    def kernel(e: dict) -> dict:
        return {"event_id": e["event_id"], "input_idx": e["input_idx"], "jet": kernel_(e, **settings)}

    return per_group(inputs, ["event_id"], ["input_idx"], [*kernels.COLUMNS, "input_idx"], kernel, "event_id long, input_idx int, jet int")


def scan(inputs: DataFrame, grid: list[dict], done: list[int] | None = None) -> DataFrame:
    """(setting, event_id, input_idx, jet) of the sequential merging for every setting of a grid that is not done yet.

    The settings multiply the rows (a fixed short list), and (setting, event) is the unit of work.
    """
    todo = [k for k in range(len(grid)) if k not in (done or [])]
    rows = inputs.withColumn("setting", F.explode(F.array(*(F.lit(k) for k in todo))))

    def kernel(e: dict) -> dict:
        k = int(e["setting"][0])
        found = [r for r in kernels.generalised_kt(e, **grid[k]) if r["input_idx"] >= 0]
        return {"setting": np.full(len(found), k), "event_id": np.full(len(found), e["event_id"][0]), "input_idx": e["input_idx"], "jet": np.array([r["jet"] for r in found])}

    return per_group(rows, ["setting", "event_id"], ["input_idx"], [*kernels.COLUMNS, "input_idx"], kernel, "setting int, event_id long, input_idx int, jet int")


def shapes(inputs: DataFrame) -> DataFrame:
    """Event shape variables of every event with at least two inputs."""
    names = kernels.SHAPES

    def kernel(e: dict) -> dict:
        if len(e["px"]) < 2:
            return {"event_id": np.zeros(0, np.int64)} | {n: np.zeros(0) for n in names}
        found = kernels.event_shape(np.stack([e["px"], e["py"], e["pz"]], 1), e["energy"])
        return {"event_id": e["event_id"][:1]} | {n: np.array([found[n]]) for n in names}

    return per_group(inputs, ["event_id"], ["input_idx"], ["energy", "px", "py", "pz"], kernel, "event_id long, " + ", ".join(f"{n} double" for n in names))


def filter_jets(trees: DataFrame, lead: float, other: float, min_tracks: int) -> DataFrame:
    """Root pseudojets that pass the cuts, with their number of inputs."""
    from .filters import jet_cut

    n = trees.where("input_idx >= 0").groupBy("event_id", "jet").agg(F.count("*").alias("n_tracks"))
    roots = trees.where("parent = -1").select("event_id", "jet", "pt", "rapidity", "phi", "energy", "px", "py", "pz")
    return jet_cut(roots.join(n, ["event_id", "jet"]), lead, other, min_tracks)


def embeddings(inputs: DataFrame, dimensions: int = 3, **settings) -> DataFrame:
    """(event_id, input_idx, dimension, eigenvalue, coordinate) of the Laplacian embedding of events with three inputs or more."""

    def kernel(e: dict) -> dict:
        n = len(e["pt"])
        if n < 3:
            none = np.zeros(0)
            return {"event_id": none.astype(np.int64), "input_idx": none.astype(np.int32), "dimension": none.astype(np.int32), "eigenvalue": none, "coordinate": none}
        values, x = kernels.embedding(e, dimensions, **settings)
        k = len(values)
        return {"event_id": np.full(n * k, e["event_id"][0]), "input_idx": np.repeat(e["input_idx"], k), "dimension": np.tile(np.arange(k), n), "eigenvalue": np.tile(values, n), "coordinate": x.ravel()}

    return per_group(inputs, ["event_id"], ["input_idx"], [*kernels.COLUMNS, "input_idx"], kernel, "event_id long, input_idx int, dimension int, eigenvalue double, coordinate double")
