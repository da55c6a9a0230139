"""Nested arrays: flatten, depth, elementwise functions, matching, distances, index arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
#: Strings that stand for true and false.
TRUE_WORDS, FALSE_WORDS = ["true", "t", "yes", "y", "1"], ["false", "f", "no", "n", "0", ""]


def depth(kind: T.DataType) -> int:
    """List levels of a column type."""
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def flatten_all(column: Column, kind: T.DataType) -> Column:
    """One flat list of all leaves, from any depth of at least one."""
    for _ in range(depth(kind) - 1):
        column = F.flatten(column)
    return column


def apply_elementwise(function: Callable[[Column], Column], column: Column, levels: int) -> Column:
    """`function` on the elements `levels` lists down."""
    return F.transform(column, lambda x: apply_elementwise(function, x, levels - 1)) if levels > 1 else F.transform(column, function)


def match_indices(values: Column, left: Column, right: Column | None = None, scalar: Column | None = None) -> Column:
    """Values at the places where left equals right, or equals a scalar."""
    zipped = F.arrays_zip(values.alias("v"), left.alias("l"), *([right.alias("r")] if right is not None else []))
    hit = (lambda x: x["l"] == x["r"]) if right is not None else (lambda x: x["l"] == scalar)
    return F.transform(F.filter(zipped, hit), lambda x: x["v"])


def take(values: Column, positions: Column) -> Column:
    """Values at zero-based positions; out of range gives null."""
    return F.transform(positions, lambda i: F.get(values, i))


def l1_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences; infinite for different lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.lit(INF)).otherwise(total)


def least_separation(a: Column, b: Column) -> Column:
    return F.array_min(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def condensed_pair(k: Column, n: Column) -> Column:
    """Struct (i, j), i < j, of the row-major condensed index k over n points; null out of range."""
    i = (n - 2 - F.floor(F.sqrt(-8.0 * k + 4.0 * n * (n - 1) - 7.0) / 2.0 - 0.5)).cast("long")
    j = (k + i + 1 - F.floor(n * (n - 1) / 2).cast("long") + F.floor((n - i) * ((n - i) - 1) / 2).cast("long")).cast("long")
    return F.when((k >= 0) & (k < n * (n - 1) / 2), F.struct(i.alias("i"), j.alias("j")))


def safe_convert(text: Column, kind: str) -> Column:
    """A typed value from its text: `None` is null, unknown words count as true for booleans."""
    if kind == "boolean":
        value = F.when(F.lower(text).isin(*FALSE_WORDS), F.lit(False)).otherwise(F.lit(True))
    else:
        value = text.try_cast(kind)
    return F.when(text == "None", None).otherwise(value)


def contains_name(names: Column, wanted: list[str], partial: bool) -> Column:
    """Whether a name equals, or contains, one of the wanted ones."""
    if not partial:
        return names.isin(*wanted)
    hit = F.lit(False)
    for w in wanted:
        hit = hit | names.contains(w)
    return hit
