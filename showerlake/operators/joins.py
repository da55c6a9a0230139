"""Matching: heritage, reverse references, nearest jets, datasets against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinematics as K


def heritage(rows: DataFrame) -> DataFrame:
    """(event_id, idx, parents, children) from start and end vertices: who ends where I start, who starts where I end."""
    ends = rows.where("end_vertex is not null").select("event_id", F.col("end_vertex").alias("start_vertex"), F.col("idx").alias("other"))
    starts = rows.where("start_vertex is not null").select("event_id", F.col("start_vertex").alias("end_vertex"), F.col("idx").alias("other"))
    sorted_ = lambda name: F.sort_array(F.collect_list("other")).alias(name)
    parents = ends.groupBy("event_id", "start_vertex").agg(sorted_("parents"))
    children = starts.groupBy("event_id", "end_vertex").agg(sorted_("children"))
    none = F.array().cast("array<int>")
    out = rows.join(parents, ["event_id", "start_vertex"], "left").join(children, ["event_id", "end_vertex"], "left")
    without_self = lambda c: F.filter(F.coalesce(c, none), lambda x: x != F.col("idx"))
    return out.select("event_id", "idx", without_self("parents").alias("parents"), without_self("children").alias("children"))


def reverse_references(sources: DataFrame, targets: DataFrame, ref: str, key: str) -> DataFrame:
    """(event_id, key, back): the last source that points at each target, -1 if none."""
    last = sources.where(F.col(ref) >= 0).groupBy("event_id", F.col(ref).alias(key)).agg(F.max("idx").alias("back"))
    return targets.select("event_id", key).join(last, ["event_id", key], "left").select("event_id", key, F.coalesce("back", F.lit(-1)).alias("back"))


def allocate(tags: DataFrame, jets: DataFrame, max_angle2: float) -> DataFrame:
    """(event_id, tag_idx, jet_idx): nearest jet of each tag, -1 beyond the limit; ties to the lowest jet."""
    j = jets.select("event_id", "jet_idx", F.col("phi").alias("jp"), F.col("rapidity").alias("jy"))
    dphi, dy = K.angular_distance(F.col("phi"), F.col("jp")), F.col("rapidity") - F.col("jy")
    near = tags.select("event_id", "tag_idx", "phi", "rapidity").join(j, "event_id", "left").groupBy("event_id", "tag_idx").agg(F.min(F.struct((dphi * dphi + dy * dy).alias("d2"), "jet_idx")).alias("b"))
    return near.select("event_id", "tag_idx", F.when(F.col("b.d2") <= max_angle2, F.col("b.jet_idx")).otherwise(-1).alias("jet_idx"))


def marry(left: DataFrame, right: DataFrame, exact: list[str], close: list[str], keep_right: list[str], rtol: float = 1e-7) -> DataFrame:
    """Join two descriptions of the same particles by (event_id, idx); disagreement is an error.

    Columns in `exact` must be equal, those in `close` within rtol; `keep_right` come from the right side.
    """
    r = right.select("event_id", "idx", *(F.col(c).alias(f"__{c}") for c in [*exact, *close]), *keep_right)
    both = left.withColumn("__left", F.lit(True)).join(r.withColumn("__right", F.lit(True)), ["event_id", "idx"], "full")
    same = F.col("__left").isNotNull() & F.col("__right").isNotNull()  # a particle without a partner is a disagreement too
    for c in exact:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    for c in close:
        same = same & (F.abs(F.col(c) - F.col(f"__{c}")) <= rtol * F.abs(F.col(f"__{c}")) + 1e-8)
    both = both.withColumn("married", F.when(F.coalesce(same, F.lit(False)), True).otherwise(F.raise_error(F.lit("the two particle lists disagree")).cast("boolean")))
    return both.drop("__left", "__right", *(f"__{c}" for c in [*exact, *close]))


def match_events(left: DataFrame, right: DataFrame, ints: list[str], floats: list[str]) -> DataFrame:
    """(row_left, row_right): for equal event_n and equal integer columns the closest float columns; both sides once.

    Mutual best matches; -1 where no partner is left.
    """
    r = right.select("event_n", F.col("row").alias("row_right"), *(F.col(c).alias(f"r_{c}") for c in [*ints, *floats]))
    near = left.join(r, "event_n")
    for c in ints:
        near = near.where(F.col(c) == F.col(f"r_{c}"))
    d = F.lit(0.0)
    for c in floats:
        d = d + F.abs(F.col(c) - F.col(f"r_{c}"))
    near = near.select("row", "row_right", d.alias("d"))
    best = near.withColumn("a", F.row_number().over(Window.partitionBy("row").orderBy("d", "row_right"))).withColumn("b", F.row_number().over(Window.partitionBy("row_right").orderBy("d", "row"))).where("a = 1 and b = 1")
    return left.select(F.col("row").alias("row_left")).join(best.select(F.col("row").alias("row_left"), "row_right"), "row_left", "left").select("row_left", F.coalesce("row_right", F.lit(-1)).alias("row_right"))


def match_greedily(left: DataFrame, right: DataFrame, ints: list[str], floats: list[str], keep, limit: int = 200) -> DataFrame:
    """(row_left, row_right) as match_events, but a row that loses its partner to a closer one takes its next choice.

    Rounds of mutual best matches among the rows still free, each stored by `keep`, until none is left: every
    round matches at least the closest free pair of each event, so the number of rounds is bounded by the rows
    of an event; over `limit` rounds are an error.
    """
    spare, taken, done = keep(left), keep(right), None
    for _ in range(limit):
        new = keep(match_events(spare, taken, ints, floats).where("row_right >= 0"))
        if new.isEmpty():
            rest = spare.select(F.col("row").alias("row_left"), F.lit(-1).cast("long").alias("row_right"))
            return rest if done is None else done.union(rest)
        done = new if done is None else keep(done.union(new))
        spare = keep(spare.join(new.select(F.col("row_left").alias("row")), "row", "left_anti"))
        taken = keep(taken.join(new.select(F.col("row_right").alias("row")), "row", "left_anti"))
    raise RuntimeError(f"matching has not ended after {limit} rounds")


def union_datasets(*frames: DataFrame) -> DataFrame:
    """Column union by name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def pile_up(main: DataFrame, inserted: DataFrame) -> DataFrame:
    """Append an inserted event's particles: its ids move past those of the main event with the same number."""
    top = main.groupBy("event_id").agg((F.max("idx") + 1).alias("shift"))
    common = [c for c in main.columns if c in inserted.columns]
    moved = inserted.join(top, "event_id", "left").withColumn("idx", (F.col("idx") + F.coalesce("shift", F.lit(0))).cast("int"))
    return main.select(common).unionByName(moved.select(common))
