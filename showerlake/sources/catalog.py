"""Stored datasets: columns and settings, names, discovery, resuming."""

from __future__ import annotations

import random
import subprocess
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The classes of clustering and the values of their parameters.
CLASSES = {
    "GeneralisedKT": {"delta_r": float, "power": float, "kind": ["angular", "taxicab", "normed", "invarient"], "pt_format": ["min", "Luclus"]},
    "IterativeCone": {"delta_r": float, "seed": float, "passes": int},
    "Spectral": {"delta_r": float, "stop": ["mean", "standard"], "refresh": bool, "dimensions": int, "kind": ["exponent", "linear", "inverse"], "laplacian": ["symmetric", "unnormalised", "pt", "energy"]},
    "Indicator": {"base_jump": float, "eigen_factor": float},
    "Splitting": {"max_cut": float},
    "SpectralKMeans": {"clusters": int, "restarts": int},
}


def check_settings(name: str, settings: dict) -> dict:
    """The settings if the class knows them all and they lie in its domains, else ValueError."""
    if name not in CLASSES:
        raise ValueError(f"unknown clustering {name}")
    for key, value in settings.items():
        domain = CLASSES[name].get(key)
        if domain is None:
            raise ValueError(f"{name} has no parameter {key}")
        if isinstance(domain, list):
            ok = value in domain
        elif domain is float:
            ok = isinstance(value, int | float) and not isinstance(value, bool)
        else:
            ok = isinstance(value, domain)
        if not ok:
            raise ValueError(f"{key}={value!r} is not allowed for {name}")
    return settings


def new_jet_name(class_name: str, existing: list[str]) -> str:
    """Class, `Jet` and the smallest positive number that is free."""
    stem, k = f"{class_name}Jet", 1
    while f"{stem}{k}" in existing:
        k += 1
    return f"{stem}{k}"


def jet_names(columns: list[str]) -> list[str]:
    return sorted({c.removesuffix("_InputIdx") for c in columns if c.endswith("_InputIdx") and "Jet" in c})


def grid(parameters: dict[str, list]) -> list[dict]:
    """All combinations of parameter values."""
    return [dict(zip(parameters, values, strict=True)) for values in product(*parameters.values())]


def rename_prefix(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.select(*(F.col(c).alias(new + c.removeprefix(old)) if c.startswith(old) else F.col(c) for c in df.columns))


def remove_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(prefix)))


def append(df: DataFrame, settings: list[str], **new) -> DataFrame:
    """New columns with a capital first letter; a clash with a setting's name is an error."""
    named = {k[:1].upper() + k[1:]: v for k, v in new.items()}
    if clash := sorted(set(named) & set(settings)):
        raise ValueError(f"settings of that name exist: {clash}")
    return df.withColumns(named)


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, in folders of `by`; re-running replaces what is there."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of the readable data files below a folder, through Spark's own reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def unfinished(events: DataFrame, done: DataFrame, key: str = "event_id", batch: int | None = None) -> DataFrame:
    """Events still to do, the first `batch` of them if asked for."""
    todo = events.join(done.select(key).distinct(), key, "left_anti")
    return todo if batch is None else todo.orderBy(key).limit(batch)


def drop_partial(jets: DataFrame, expected: int) -> DataFrame:
    """Rows of settings that have all their events."""
    full = jets.groupBy("jet_name").agg(F.countDistinct("event_id").alias("n")).where(F.col("n") >= expected).select("jet_name")
    return jets.join(full, "jet_name", "left_semi")


def same_settings(table: DataFrame, wanted: dict, rtol: float = 1e-5) -> DataFrame:
    """Names of stored settings (name, param, value text) equal to the wanted ones; numbers may differ by rtol."""
    hit = F.lit(False)
    for k, v in wanted.items():
        if isinstance(v, int | float) and not isinstance(v, bool):
            same = F.abs(F.col("value").try_cast("double") - float(v)) <= rtol * abs(float(v)) + 1e-8
        else:
            same = F.col("value") == str(v)
        hit = hit | ((F.col("param") == k) & F.coalesce(same, F.lit(False)))
    return table.groupBy("name").agg(F.countDistinct(F.when(hit, F.col("param"))).alias("n")).where(F.col("n") == len(wanted)).select("name")


def provenance(folder: str) -> dict[str, str]:
    """Branch, commit, time and subject of the checkout that made a dataset; empty outside one."""
    try:
        out = subprocess.run(["git", "-C", folder, "log", "-1", "--format=%H%n%cI%n%s%n%D"], capture_output=True, text=True, timeout=10, check=True).stdout.split("\n")
    except (OSError, subprocess.SubprocessError):
        return {}
    return dict(zip(["commit", "time", "message", "branch"], out, strict=False))


def random_settings(name: str, n: int, seed: int, ranges: dict[str, tuple[float, float]]) -> list[dict]:
    """n random settings of a class: choices from its domains, numbers from `ranges`; the same for the same seed."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        one = {}
        for key, domain in CLASSES[name].items():
            if isinstance(domain, list):
                one[key] = draw.choice(domain)
            elif domain is bool:
                one[key] = draw.random() < 0.5
            elif key in ranges:
                low, high = ranges[key]
                one[key] = draw.randint(int(low), int(high)) if domain is int else draw.uniform(low, high)
        out.append(check_settings(name, one))
    return out


def neighbour_settings(name: str, best: dict, step: float, ranges: dict[str, tuple[float, float]]) -> list[dict]:
    """Settings one step away from the best so far: each number up and down, each choice replaced."""
    out = []
    for key, value in best.items():
        domain = CLASSES[name][key]
        if isinstance(domain, list):
            out += [best | {key: other} for other in domain if other != value]
        elif domain is bool:
            out.append(best | {key: not value})
        elif key in ranges:
            low, high = ranges[key]
            size = max(1, round(step * (high - low))) if domain is int else step * (high - low)
            out += [best | {key: moved} for moved in (value - size, value + size) if low <= moved <= high]
    return out


def remove_scores(params: DataFrame, suffixes: list[str]) -> DataFrame:
    """Stored settings without the scores of an earlier run, told by the ends of their names."""
    old = F.lit(False)
    for suffix in suffixes:
        old = old | F.col("param").endswith(suffix)
    return params.where(~old)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed; a name that is not there or would be there twice is an error."""
    if absent := sorted(set(names) - set(df.columns)):
        raise ValueError(f"no such columns: {absent}")
    after = [names.get(c, c) for c in df.columns]
    if len(set(after)) < len(after):
        raise ValueError("two columns would share a name")
    return df.toDF(*after)
