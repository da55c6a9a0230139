"""Operators that walk, rank and match whole tables, against plain versions on small fixtures."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from showerlake.operators import graph, joins, masses, pairs, ranges, ranking, stats
from showerlake.session import keeper
from showerlake.streaming import windows


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i * 7919 % 1000, rng.randrange(5)) for i in range(400)]
    got = ranges.running_sums(spark.createDataFrame(rows, "g string, x long, n long").repartition(5), ["g"], ["x"], {"upto": "n"}).collect()
    assert sorted((r["g"], r["x"], r["upto"]) for r in got) == sorted((g, x, sum(m for h, y, m in rows if h == g and y <= x)) for g, x, _ in rows)
    none = ranges.running_sums(spark.createDataFrame(rows, "g string, x long, n long").limit(0), ["g"], ["x"], {"upto": "n"})
    assert none.count() == 0


def test_ranks_and_windows_of_masses(spark):
    rng = random.Random(2)
    rows = [("g", i, float(rng.randrange(40))) for i in range(150)]
    frame = spark.createDataFrame(rows, "g string, event_id long, mass double").repartition(4)
    values = [r[2] for r in rows]
    rank = {v: sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values}
    assert {r["mass"]: r["rank"] for r in stats.average_ranks(frame, "mass", "rank", ["g"]).collect()} == rank
    most = max(sum(v <= x < v + 5 for x in values) for v in values)
    assert ranking.quality_fraction(frame, "g", 10.0, 0.5).first()["events_per_window"] == pytest.approx(len(values) / most)
    ordered = sorted(values)
    n = math.ceil(len(values) * 0.4)
    width = min(b - a for a, b in zip(ordered, ordered[n - 1 :])) / len(values)
    assert ranking.quality_width(frame, "g", 0.4).first()["width_per_event"] == pytest.approx(width)


def test_walk_goes_to_the_end_and_refuses_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(0, 50), (50, 41), (3, 60)]
    edges, starts = spark.createDataFrame(links, "parent long, child long"), spark.createDataFrame([(0,)], "start long")
    got = graph.walk(starts, edges, [], keeper(spark))
    assert {r["node"] for r in graph.leaves(got, edges, []).collect()} == {40, 41, 60}
    assert {r["node"]: r["rank"] for r in graph.ranks(got, edges, []).collect()} == {i: i for i in range(40)} | {40: 40, 41: 40, 60: 40, 50: 1}
    with pytest.raises(RuntimeError):
        graph.walk(starts, edges.union(spark.createDataFrame([(40, 0)], "parent long, child long")), [], keeper(spark), limit=60)


def test_chain_beyond_its_steps_is_an_error(spark):
    nodes = spark.createDataFrame([(1, i, "k") for i in range(20)], "event_id long, node long, kind string")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(19)], "event_id long, parent long, child long")
    assert {r["last"] for r in graph.last_instance(nodes, edges, "kind", 5).collect()} == {19}
    with pytest.raises(Exception, match="links"):
        graph.last_instance(nodes, edges, "kind", 3).collect()


def test_marriage_without_a_partner_is_an_error(spark):
    left = spark.createDataFrame([(1, 0, 5, 1.0), (1, 1, 5, 2.0)], "event_id long, idx int, pid int, e double")
    assert joins.marry(left, left.withColumn("tower", F.lit(3)), ["pid"], ["e"], ["tower"]).count() == 2
    for a, b in ((left, left.where("idx = 0")), (left.where("idx = 1"), left)):
        with pytest.raises(Exception, match="disagree"):
            joins.marry(a, b.withColumn("tower", F.lit(3)), ["pid"], ["e"], ["tower"]).collect()


def test_greedy_matching_takes_the_next_choice(spark):
    rng = random.Random(3)
    make = lambda base: [(i % 6, base + i, rng.randrange(2), round(rng.uniform(0, 100), 3)) for i in range(60)]
    left, right = make(0), make(1000)
    frames = [spark.createDataFrame(x, "event_n long, row long, k int, x double") for x in (left, right)]
    got = {r["row_left"]: r["row_right"] for r in joins.match_greedily(*frames, ["k"], ["x"], keeper(spark)).collect()}
    want = {r[1]: -1 for r in left}
    for _, a, b in sorted((abs(p[3] - q[3]), p[1], q[1]) for p in left for q in right if p[0] == q[0] and p[2] == q[2]):
        if want[a] == -1 and b not in want.values():
            want[a] = b
    assert got == want


def test_width_with_a_point_opposite_the_centre(spark):
    rows = [(1, -0.2, 2.9147173566404803), (1, 0.25, -0.059869870028291139), (1, 0.0, -3.0344570966970621), (2, 0.0, 0.3), (2, 3.0, 0.3), (3, 1.0, 1.0)]
    got = {r["event_id"]: r["width"] for r in pairs.widths(spark.createDataFrame(rows, "event_id long, rap double, phi double"), "rap", "phi", ["event_id"]).collect()}
    assert got[1] == pytest.approx(3.3391, abs=1e-4) and got[2] == pytest.approx(3.0) and got[3] == 0.0


def test_best_pair_by_brute_force(spark):
    rng, rows = random.Random(4), []
    for event in range(40):
        for idx in range(rng.randrange(1, 7)):
            px, py, pz = (rng.gauss(0, 20) for _ in range(3))
            rows.append((event, idx, math.hypot(px, py), px, py, pz, math.sqrt(px * px + py * py + pz * pz + rng.random())))
    got = masses.best_pair(masses.pt_pairs(spark.createDataFrame(rows, "event_id long, idx int, pt double, px double, py double, pz double, energy double")), 40.0).collect()
    want = {}
    for event in range(40):
        top = sorted((r for r in rows if r[0] == event), key=lambda r: (-r[2], r[1]))[:4]
        mass = {}
        for a, b in itertools.combinations(range(len(top)), 2):
            e, x, y, z = (top[a][k] + top[b][k] for k in (6, 3, 4, 5))
            mass[a + 1, b + 1] = math.sqrt(max(e * e - x * x - y * y - z * z, 0))
        if mass:
            best = min(mass, key=lambda p: (round(abs(mass[p] - 40), 9), p))
            second = next((m for p, m in mass.items() if not set(p) & set(best)), 0.0)
            want[event] = (*best, pytest.approx(mass[best]), pytest.approx(second))
    assert {r["event_id"]: (r["r1"], r["r2"], r["mass"], r["second"]) for r in got} == want


def test_stream_keeps_open_windows_and_the_last_state_of_each(spark, tmp_path):
    for n in range(3):
        rows = [(i, f"2024-01-0{1 + i % 2} 10:0{i}:00", 1, "a", float(n), "") for i in range(4)]
        frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
        frame.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "events.parquet" / f"p{n}"))
    (tmp_path / "flat").mkdir()
    for n, path in enumerate(sorted((tmp_path / "events.parquet").rglob("part*.parquet"))):
        path.rename(tmp_path / "flat" / f"events.parquet{n}.parquet")
    got = windows.run_available(spark, str(tmp_path / "flat")).collect()
    assert sorted((r["start"].day, r["n"], r["total"]) for r in got) == [(1, 6, 6.0), (2, 6, 6.0)]
