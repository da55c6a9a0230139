"""Queries against their SQL where a comparison is a tie but for rounding."""

import duckdb

from showerlake.plans import registry


def against_sql(spark, folder, name, lines):
    """Rows of a query and of its SQL over line items (order, number, part, supplier, quantity)."""
    rows = ", ".join(f"({o}::BIGINT, {p}::BIGINT, {s}::BIGINT, {n}::INTEGER, {q}::DOUBLE, 1.0::DOUBLE, 0.05::DOUBLE, TIMESTAMP '2020-01-01')" for o, n, p, s, q in lines)
    duck = duckdb.connect()
    duck.sql(f"CREATE TABLE lineitem AS SELECT * FROM (VALUES {rows}) AS t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_shipdate)")
    duck.sql(f"COPY lineitem TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    got = registry.queries()[name](spark, str(folder)).collect()
    return sorted(map(tuple, got)), sorted(duck.sql(registry.oracle_sql()[name]).fetchall())


def test_two_inputs_at_the_radius(spark, tmp_path):
    ends = [((13652, 762), (5498, 688)), ((3818, 496), (19204, 776)), ((14938, 115), (301, 236)), ((19580, 24), (2990, 935)), ((3302, 235), (5996, 470))]
    sizes = [(1, 3), (3, 1), (7, 7), (3, 49), (10, 23), (50, 33)]
    cases = [pair for a, b in ends for pair in ((a, b), (b, a))]
    lines = [(k * 10 + m, n, *end, pt) for k, pair in enumerate(cases) for m, pts in enumerate(sizes) for n, (end, pt) in enumerate(zip(pair, pts))]
    got, want = against_sql(spark, tmp_path, "c_pairs_only", lines)
    assert len(want) == 60 and {jets for _, jets in want} == {1, 2} and got == want


def test_a_point_opposite_the_centre(spark, tmp_path):
    events = [
        [(2, 14266, 381), (4, 13630, 939), (4, 13634, 24)], [(1, 233, 588), (1, 10354, 623), (5, 5980, 398)], [(3, 3129, 834), (5, 3995, 112), (7, 14280, 413)],
        [(3, 14885, 659), (6, 19, 54), (6, 8498, 987)], [(2, 14582, 455), (4, 19778, 380), (5, 14326, 348)], [(4, 808, 282), (5, 8063, 547), (6, 15944, 550)], [(1, 7, 7)],
    ]
    got, want = against_sql(spark, tmp_path, "d_width", [(k, n, p, s, 1) for k, e in enumerate(events) for n, p, s in e])
    assert len(want) == 7 and got == want
