"""Hand-checked cases of the event operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from showerlake.functions import arrays as A
from showerlake.functions import kinematics as K
from showerlake.operators import clustering, filters, geometry, graph, joins, kernels, masses, pairs, ranking, sets, stats, tags, trees, truth
from showerlake.sources import catalog, hepmc, text

CHILDREN = [[], [2, 3], [5], [6, 5], [], [], [7, 8, 9], [], [], [], []]


@pytest.fixture(scope="module")
def family(spark):
    edges = spark.createDataFrame([(0, p, c) for p, cs in enumerate(CHILDREN) for c in cs], "event_id int, parent int, child int")
    kinds = [4, 5, 5, 3, 2, 1, -5, 1, 7, 11, 12]
    return edges, spark.createDataFrame([(0, i, abs(k)) for i, k in enumerate(kinds)], "event_id int, node int, kind int")


def test_leaf_descendants(spark, family):
    starts = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "event_id int, start int")
    found = graph.leaves(graph.descendants(starts, family[0], 4), family[0]).collect()
    got = {s: {r["node"] for r in found if r["start"] == s} for s in (0, 1, 2)}
    assert got == {0: {0}, 1: {5, 7, 8, 9}, 2: {5}}
    again = graph.descendants_until_done(starts, family[0], ["event_id"], lambda df: df.cache())
    assert {r["node"] for r in again.where("start = 1").collect()} == {1, 2, 3, 5, 6, 7, 8, 9}


def test_last_b_roots_ranks_and_hops(spark, family):
    edges, nodes = family
    assert {r["node"] for r in graph.last_of_kind(nodes.where("kind = 5"), edges, "kind").collect()} == {2, 6}
    assert {r["node"] for r in graph.roots(nodes.select("event_id", "node"), edges).collect()} == {0, 1, 4, 10}
    reached = graph.descendants(spark.createDataFrame([(0, 1)], "event_id int, start int"), edges, 4)
    assert {r["node"]: r["rank"] for r in graph.ranks(reached, edges).collect()} == {1: 0, 2: 1, 3: 1, 5: 3, 6: 2, 7: 3, 8: 3, 9: 3}
    hops = graph.hop_distance(nodes.select("event_id", "node"), edges, 4)
    assert hops.where("start = 2 and node = 3").first()["hops"] == 2


def test_angles_and_rapidity_edges(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(K.confine_angle(F.lit(math.pi))) == pytest.approx(-math.pi)
    assert value(K.angular_distance(F.lit(0.1), F.lit(2 * math.pi - 0.1))) == pytest.approx(0.2)
    assert value(K.pseudorapidity(F.lit(0.0))) == math.inf and value(K.pseudorapidity(F.lit(math.pi))) == -math.inf
    assert value(K.rapidity(F.lit(0.0), F.lit(-3.0), F.lit(3.0))) == -math.inf and value(K.rapidity(F.lit(1.0), F.lit(0.0), F.lit(2.0))) == 0
    assert math.isnan(value(K.rapidity(F.lit(0.0), F.lit(0.0), F.lit(0.0)))) and math.isnan(value(K.mass(F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(0.0))))


def test_array_functions(spark):
    df = spark.createDataFrame([([[[1, 2], [3]], [[4]]], [1.0, 2.0], [3.0, 0.5], [1, 2, 3], [1, 5, 3])], "n array<array<array<int>>>, a array<double>, b array<double>, l array<int>, m array<int>")
    row = df.select(
        A.flatten_all(F.col("n"), df.schema["n"].dataType).alias("flat"), A.l1_distance(F.col("a"), F.col("b")).alias("d"), A.l1_distance(F.col("a"), F.col("l")).alias("inf"), A.least_separation(F.col("a"), F.col("b")).alias("s"),
        A.match_indices(F.col("l"), F.col("l"), F.col("m")).alias("m"), A.take(F.col("l"), F.array(F.lit(2), F.lit(9))).alias("t"), A.apply_elementwise(lambda x: x + 1, F.col("n"), 3).alias("e"),
    ).first()
    assert (row["flat"], row["d"], row["inf"], row["s"], row["m"], row["t"], row["e"]) == ([1, 2, 3, 4], 3.5, math.inf, 1.5, [1, 3], [3, None], [[[2, 3], [4]], [[5]]])
    pairs_ = spark.range(12).select(A.condensed_pair(F.col("id"), F.lit(5)).alias("p")).collect()
    assert [tuple(r["p"]) if r["p"] else None for r in pairs_] == [(i, j) for i in range(5) for j in range(i + 1, 5)] + [None, None]


def test_width_and_neighbours(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (0, 0.0, math.pi), (0, 1.0, 2 * math.pi), (1, 0.0, 0.0), (1, 0.0, -1.5 * math.pi), (2, 5.0, 1.0)], "event_id int, y double, phi double")
    got = {r["event_id"]: r["width"] for r in pairs.widths(points, "y", "phi", ["event_id"]).collect()}
    assert got[1] == pytest.approx(0.5 * math.pi) and got[2] == 0
    x = [3, 1, 2.5]
    d = spark.createDataFrame([(0, i, j, float(abs(x[i] - x[j]))) for i in range(3) for j in range(3) if i != j], "event_id int, i int, j int, d double")
    assert sorted((r["i"], r["j"]) for r in pairs.nearest_neighbours(d, 1).collect()) == [(0, 2), (1, 2), (2, 0), (2, 1)]


def test_quality_width_and_fraction(spark):
    m = spark.createDataFrame([("g", i, v) for i, v in enumerate([1.0, 2.0, 5.0])] + [("h", 9, 4.0)], "g string, event_id int, mass double")
    got = {r["g"]: r["width_per_event"] for r in ranking.quality_width(m, "g", 0.4).collect()}
    assert got == {"g": pytest.approx(1 / 3), "h": None}
    assert ranking.quality_fraction(m.where("g = 'g'"), "g", 1.0, 3.0).first()["events_per_window"] == 1.5


def inputs_of(points):
    rows = []
    for event, i, pt, y, phi in points:
        px, py, pz, e = pt * math.cos(phi), pt * math.sin(phi), pt * math.sinh(y), pt * math.cosh(y)
        rows.append((event, i, float(pt), float(y), float(phi), e, px, py, pz))
    return rows


SCHEMA = "event_id long, input_idx int, pt double, rapidity double, phi double, energy double, px double, py double, pz double"


@pytest.mark.parametrize("power", [-1.0, 0.0, 1.0])
def test_sequential_merging(spark, power):
    rows = inputs_of([(1, 0, 1, 0, 0), (1, 1, 1, 0, 0), (2, 0, 1, 0, 0), (2, 1, 1, 0, math.pi), (3, 0, 5, 0, 0)])
    trees = clustering.generalised_kt(spark.createDataFrame(rows, SCHEMA), 0.4, power).collect()
    one = [r for r in trees if r["event_id"] == 1]
    assert len(one) == 3 and {r["jet"] for r in one} == {2} and [(r["child1"], r["child2"], r["rank"]) for r in one if r["pj_idx"] == 2] == [(1, 0, 1)]
    assert len({r["jet"] for r in trees if r["event_id"] == 2}) == 2 and len([r for r in trees if r["event_id"] == 3]) == 1


def test_merging_matches_brute_force_and_keeps_momenta():
    rng = np.random.default_rng(7)
    for _ in range(10):
        n = 12
        pt, y, phi = rng.uniform(1, 50, n), rng.normal(size=n), rng.uniform(-math.pi, math.pi, n)
        e = dict(zip(["event_id", "input_idx", *kernels.COLUMNS], np.array(inputs_of([(0, i, *v) for i, v in enumerate(zip(pt, y, phi))])).T))
        found = kernels.generalised_kt(e, 0.8, -1.0)
        roots = [r for r in found if r["parent"] < 0]
        assert sum(r["energy"] for r in roots) == pytest.approx(e["energy"].sum()) and sum(r["size"] for r in roots) == n
        live, jets = [{c: e[c][i] for c in kernels.COLUMNS} | {"of": {i}} for i in range(n)], []
        while live:
            options = [(a["pt"] ** -2 * 0.64, i, i) for i, a in enumerate(live)]
            for i, a in enumerate(live):
                for j, b in enumerate(live[:i]):
                    dphi = abs((a["phi"] - b["phi"] + math.pi) % (2 * math.pi) - math.pi)
                    options.append((min(a["pt"] ** -2, b["pt"] ** -2) * ((a["rapidity"] - b["rapidity"]) ** 2 + dphi**2), i, j))
            _, i, j = min(options)
            if i == j:
                jets.append(live.pop(i)["of"])
                continue
            a, b = live[i], live[j]
            new = {c: a[c] + b[c] for c in ("energy", "px", "py", "pz")} | {"of": a["of"] | b["of"]}
            new |= {"pt": math.hypot(new["px"], new["py"]), "phi": math.atan2(new["py"], new["px"])}
            new["rapidity"] = kernels.rapidity_of(new["energy"], new["pz"], new["pt"])
            live = [x for k, x in enumerate(live) if k not in (i, j)] + [new]
        got = {}
        for r in found:
            if r["input_idx"] >= 0:
                got.setdefault(r["jet"], set()).add(r["input_idx"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, jets))


@pytest.mark.parametrize("name", sorted(kernels.KERNELS))
def test_two_clear_groups(spark, name):
    rng = np.random.default_rng(3)
    rows = [(1, i, 10 + rng.random(), 2.0 * (i % 2) + rng.normal() * 0.05, 2.5 * (i % 2) + rng.normal() * 0.05) for i in range(10)]
    settings = {"spectral": {"delta_r": 0.4, "stop": "standard", "dimensions": 1}, "spectral_kmeans": {"clusters": 2}, "indicator": {"dimensions": 1}, "splitting": {"dimensions": 1}}.get(name, {})
    got = clustering.labelled(spark.createDataFrame(inputs_of(rows), SCHEMA), name, **settings).collect()
    even, odd = {r["jet"] for r in got if r["input_idx"] % 2 == 0}, {r["jet"] for r in got if r["input_idx"] % 2}
    assert len(got) == 10
    if name == "spectral_kmeans":  # directions up to sign: both sides of a cut lie on one axis
        assert len(even | odd) <= 2
    else:
        assert not even & odd


def test_jet_cut_empties_events_without_a_leading_jet(spark):
    jets = spark.createDataFrame([(1, 40.0, 3), (1, 20.0, 2), (1, 10.0, 5), (2, 25.0, 9), (3, 50.0, 1)], "event_id int, pt double, n_tracks int")
    assert sorted((r["event_id"], r["pt"]) for r in filters.jet_cut(jets, 30, 15, 2).collect()) == [(1, 20.0), (1, 40.0)]


def test_allocation_and_mass_share(spark):
    tags = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.1, 0.0), (2, 0, 0.0, 0.0)], "event_id int, tag_idx int, phi double, rapidity double")
    jets = spark.createDataFrame([(1, 0, 0.1, 0.0), (1, 1, -3.1, 0.0)], "event_id int, jet_idx int, phi double, rapidity double")
    assert sorted(tuple(r) for r in joins.allocate(tags, jets, 0.64).collect()) == [(1, 0, 0), (1, 1, 1), (2, 0, -1)]
    links = spark.createDataFrame([(1, 6, 0, 10.0, 0.0, 0.0, 1.0), (1, 6, 0, 10.0, 1.0, 0.0, 3.0), (1, 6, 1, 1.0, 0.0, 0.0, 0.0)], "event_id int, tag int, jet int, energy double, px double, py double, pz double")
    best = masses.share_of_mass(links).where("is_best").first()
    assert best["jet"] == 0 and best["mass2"] == 400 - 1 - 16


def test_closest_approach_and_vertices(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 1, 2.0, 1.0, 0.0, 0.0, 1.0, 0.0), (1, 2, 0.0, 0.0, 5.0, 1.0, 0.0, 0.0)], "event_id int, idx int, x double, y double, z double, px double, py double, pz double")
    got = {(r["i"], r["j"]): r for r in geometry.closest_approach(lines).collect()}
    assert got[0, 1]["distance2"] == pytest.approx(0) and (got[0, 1]["mid_x"], got[0, 1]["mid_y"]) == (2, 0)
    assert got[0, 2]["parallel"] and got[0, 2]["distance2"] == pytest.approx(25)
    found = geometry.vertices(lines, 0.1).collect()
    assert len(found) == 1 and found[0]["x"] == pytest.approx(2)


def test_event_shapes():
    pencil = kernels.event_shape(np.array([[0, 0, 1.0], [0, 0, -1.0]]))
    assert pencil["thrust"] == pytest.approx(1) and pencil["sphericity"] == pytest.approx(0)
    round_ = kernels.event_shape(np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1.0]]))
    assert round_["sphericity"] == pytest.approx(1) and round_["c"] == pytest.approx(1) and round_["thrust"] == pytest.approx(1 / math.sqrt(3))


def test_statistics_edges(spark):
    rows = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (0, 2, 2), (1, 1, 1), (1, 1, 2), (2, 1, 1)], "event_id int, a int, b int")
    got = {r["event_id"]: r["rand"] for r in stats.rand_index(rows, "a", "b", ["event_id"]).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 1.0}
    scored = spark.createDataFrame([(0, 0.1, 0), (0, 0.4, 0), (0, 0.35, 1), (0, 0.8, 1), (1, 1.0, 1)], "g int, s double, y int")
    assert {r["g"]: r["auc"] for r in stats.roc_auc(scored, "s", "y", ["g"]).collect()} == {0: 0.75, 1: None}


def test_event_text_round_trip(spark, tmp_path):
    text = ["HepMC::Version 2.06", "E 7 -1 1.5 0.1 0.2 3 1 2 1 2 2 11 12 1 0.5", 'N 1 "w"', "U GEV MM", "V -1 0 1 2 3 4 0 2 0", "P 1 25 1 2 3 4.5 40 2 0 0 -2 0", "P 2 5 0.5 0 0 1 0 1 0 0 0 0", "V -2 0 0 0 0 0 0 1 0", "P 3 -5 1 0 0 1 0 1 0 0 0 0"]
    (tmp_path / "a.hepmc").write_text("\n".join(text))
    got = hepmc.from_lines(hepmc.read_lines(spark, str(tmp_path / "a.hepmc")))
    event = got["events"].first()
    assert (event["event_id"], event["scale"], event["random_states"], event["weights"]) == (7, 1.5, [11, 12], [0.5])
    assert [tuple(r)[1:4] + (r["start_vertex"], r["end_vertex"]) for r in got["particles"].orderBy("idx").collect()] == [(0, 1, 25, -1, -2), (1, 2, 5, -1, 0), (2, 3, -5, -2, 0)]
    assert got["vertices"].count() == 2 and got["headers"].count() == 2
    hepmc.write_lines(hepmc.to_lines(got["particles"]), str(tmp_path / "out"))
    back = hepmc.from_lines(hepmc.read_lines(spark, str(tmp_path / "out" / "*")))["particles"]
    assert sorted((r["mcpid"], r["px"]) for r in back.collect()) == [(-5, 1.0), (5, 0.5), (25, 1.0)]


def test_sets_and_folds(spark):
    rows = spark.createDataFrame([(i, i * 2) for i in range(10)], "event_id long, x long")
    done, todo = sets.split_unfinished(rows, rows.where("event_id < 4"))
    assert done.count() == 4 and todo.count() == 6
    assert sets.combine([done, todo, done], drop_duplicates=True).count() == 10
    assert sorted(r["part"] for r in sets.split_by_bounds(rows, "event_id", [2, 7]).select("part").collect()) == [0] * 2 + [1] * 5 + [2] * 3
    assert {r["fold"] for r in sets.folds(rows, "event_id", 3).collect()} <= {0, 1, 2}


def test_batches_carry_unfinished_groups(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.createDataFrame([(g, i) for g in range(7) for i in range(g + 1)], "event_id long, v long")
        out = clustering.per_group(rows, ["event_id"], ["v"], ["v"], lambda e: {"event_id": e["event_id"][:1], "n": np.array([len(e["v"])])}, "event_id long, n long")
        assert {r["event_id"]: r["n"] for r in out.collect()} == {g: g + 1 for g in range(7)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tag_groups_and_chains(spark, family):
    leaves = spark.createDataFrame([(1, t, leaf) for t, ls in {2: [5], 3: [5, 8, 9], 4: [4], 10: []}.items() for leaf in ls], "event_id long, tag long, leaf long")
    assert sorted(tuple(r) for r in tags.tag_groups(leaves).collect()) == [(1, 2, 2), (1, 2, 3), (1, 4, 4)]
    found = tags.tag_particles(family[1], family[0], F.col("kind") == 5, F.col("kind") == 4, lambda df: df.cache())
    assert {r["node"] for r in found.collect()} == {2}


def test_tree_leaf_sets_and_joins(spark):
    rows = inputs_of([(1, 0, 1, 0, 0), (1, 1, 2, 0, 0.1), (1, 2, 4, 0, 0.3)])
    built = clustering.generalised_kt(spark.createDataFrame(rows, SCHEMA), 1.0, 0.0)
    sets_ = {}
    for r in trees.leaf_sets(built, lambda df: df.cache()).collect():
        sets_.setdefault(r["pj_idx"], set()).add(r["leaf"])
    assert sets_ == {0: {0}, 1: {1}, 2: {2}, 3: {0, 1}, 4: {0, 1, 2}}
    first = trees.joins_walked(built).where("pj_idx = 3").first()
    assert (first["left"], first["right"]) == (1, 0) and first["d_phi"] == pytest.approx(0.1)


def test_settings_names_and_text(spark):
    assert catalog.new_jet_name("Cone", ["ConeJet1", "ConeJet3"]) == "ConeJet2"
    assert catalog.jet_names(["AJet1_InputIdx", "AJet1_PT", "B_InputIdx"]) == ["AJet1"]
    for bad in ({"delta_r": "x"}, {"other": 1}, {"kind": "none"}):
        with pytest.raises(ValueError):
            catalog.check_settings("GeneralisedKT", bad)
    df = spark.createDataFrame([(1, 2)], "A_x int, B_y int")
    assert catalog.rename_prefix(df, "A_", "C_").columns == ["C_x", "B_y"] and catalog.remove_prefix(df, "A_").columns == ["B_y"]
    assert catalog.append(df, [], new=F.lit(1)).columns == ["A_x", "B_y", "New"]
    lines = spark.createDataFrame([('<particle id="5" name="b" antiName="bbar" spinType="2" chargeType="-1">',)], "line string")
    assert sorted(tuple(r) for r in text.particle_table(lines).collect()) == [(-5, "bbar", 1 / 3, 0.5), (5, "b", -1 / 3, 0.5)]


def test_matching_points_and_random_settings(spark):
    found = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 5.0, 0.0, 0.0)], "event_id long, idx long, x double, y double, z double")
    true = spark.createDataFrame([(1, 7, 0.5, 0.0, 0.0), (2, 8, 1.0, 1.0, 1.0)], "event_id long, idx long, x double, y double, z double")
    got = sorted((r["event_id"], r["found"], r["true"]) for r in truth.match_points(found, true).collect())
    assert got == [(1, 0, 7), (1, 1, -1), (2, -1, 8)]
    one = catalog.random_settings("GeneralisedKT", 4, 1, {"delta_r": (0.3, 1.2), "power": (-1, 1)})
    assert one == catalog.random_settings("GeneralisedKT", 4, 1, {"delta_r": (0.3, 1.2), "power": (-1, 1)}) and len(one) == 4
    assert all(0.3 <= n["delta_r"] <= 1.2 for n in catalog.neighbour_settings("GeneralisedKT", one[0], 0.1, {"delta_r": (0.3, 1.2)}))


def test_epps_singleton_grows_with_the_difference(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v), s) for g, shift in (("same", 0.0), ("apart", 1.0)) for s in (0, 1) for v in rng.normal(shift * s, 1, 300)]
    got = {r["g"]: r["statistic"] for r in stats.epps_singleton(spark.createDataFrame(rows, "g string, v double, s int"), "v", "s", ["g"]).collect()}
    assert got["same"] < 15 < 60 < got["apart"]
