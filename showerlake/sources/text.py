"""Small text formats: metric dictionaries, cluster listings, particle tables, jet-input summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary_lines(inputs: DataFrame) -> DataFrame:
    """One space-separated line `idx px py pz e` per input."""
    return inputs.select("event_id", F.concat_ws(" ", "input_idx", "px", "py", "pz", "energy").alias("line"))


def metric_rows(lines: DataFrame) -> DataFrame:
    """(class, variable, value) of lines `{'<class><id>_<variable>': value, ...}`: letters before the digits, then what follows."""
    entry = F.explode(F.expr(r"regexp_extract_all(line, '[\'\"]([^\'\"]+)[\'\"]\\s*:\\s*(-?[0-9.eE+-]+|nan|inf)', 0)"))
    e = lines.select(entry.alias("e"))
    key, value = F.regexp_extract("e", r"""['"]([^'"]+)['"]""", 1), F.regexp_extract("e", r":\s*(\S+)$", 1).try_cast("double")
    return e.select(F.regexp_extract(key, r"^([A-Za-z]+)\d*", 1).alias("class"), F.regexp_extract(key, r"^[A-Za-z]+\d*_?(.*)$", 1).alias("variable"), value.alias("value"))


def cluster_listing(lines: DataFrame) -> DataFrame:
    """(event_id, pj_idx, parent, child1, child2, input_idx, pt, rapidity, phi, energy, px, py, pz) of rows (event_id, line).

    Header lines start with `#`. A line is five integers, then seven numbers; ids are kept as they are.
    """
    f = F.split(F.trim("line"), r"\s+")
    rows = lines.where(~F.col("line").startswith("#") & (F.trim("line") != "")).select("event_id", f.alias("f"))
    ints, numbers = ["pj_idx", "parent", "child1", "child2", "input_idx"], ["pt", "rapidity", "phi", "energy", "px", "py", "pz"]
    return rows.select("event_id", *(F.get("f", F.lit(i)).try_cast("int").alias(c) for i, c in enumerate(ints)), *(F.get("f", F.lit(i + 5)).try_cast("double").alias(c) for i, c in enumerate(numbers)))


def particle_table(lines: DataFrame) -> DataFrame:
    """(id, name, charge, spin, has_anti) of lines with name="value" attributes; antiparticles are rows of their own."""
    get = lambda a: F.regexp_extract("line", rf'\b{a}="([^"]*)"', 1)
    base = lines.where(get("id") != "").select(get("id").cast("int").alias("id"), get("name").alias("name"), get("antiName").alias("anti"), (F.coalesce(get("chargeType").try_cast("int"), F.lit(0)) / 3).alias("charge"), ((F.coalesce(get("spinType").try_cast("int"), F.lit(1)) - 1) / 2).alias("spin"))
    plain = base.select("id", F.when(F.col("name") == "", F.col("id").cast("string")).otherwise(F.col("name")).alias("name"), "charge", "spin")
    anti = base.where("anti <> ''").select((-F.col("id")).alias("id"), F.col("anti").alias("name"), (-F.col("charge")).alias("charge"), "spin")
    return plain.union(anti)
