import numpy as np
from pyspark.sql import functions as F

from gridloom.functions.wkt import contains, edges_of, outline, parse_outlines, point_x, point_y
from gridloom.operators.fill import fill_missing, filled_values
from gridloom.operators.near import METRICS, Pivots, VantageTree, outlines, pairs_within, points_in_outlines, radius_join


def test_fill_backs_off_and_marks(spark):
    rows = [(1, "a", "d1", 1.0, "x"), (2, "a", "d1", 3.0, "x"), (3, "a", "d1", None, None), (4, "a", "d2", None, "y"), (5, "b", "d1", None, None), (6, None, "d1", None, "z"), (6, None, "d1", None, "z")]
    df = spark.createDataFrame(rows, "id long, g string, day string, v double, k string").withColumn("v_level", F.lit("clash")).withColumn("extra", F.lit(7))
    out = fill_missing(df, {"v": "median", "k": "mode"}, [(["g", "day"], 2), (["g"], 1)])
    got = {r.id: r for r in out.collect()}
    assert out.count() == 7
    assert (got[3].v, got[3].v_filled, got[3].v_level) == (1.0, True, 0)
    assert (got[4].v, got[4].v_filled, got[4].v_level) == (1.0, True, 1)
    assert (got[5].v, got[5].v_filled, got[5].v_level) == (None, False, None)
    assert got[6].v is None and got[1].v_filled is False
    assert got[3].k == "x" and got[3].k_filled and not got[4].k_filled and got[5].k is None
    assert "extra" in out.columns
    assert {r.id for r in filled_values(out, "id", ["v"]).collect()} == {3, 4}
    assert {r.id for r in filled_values(out, "id", ["v"], "left").collect()} == {5, 6}


def test_fill_empty(spark):
    df = spark.createDataFrame([], "id long, g string, v double")
    assert fill_missing(df, {"v": "median"}, [(["g"], 1)]).count() == 0


def test_point_spellings(spark):
    rows = [("POINT (1 2)",), ("point ( 1.0   2.00 )",), ("SRID=32604;POINT(1e0 2)",), ("POINT Z (1 2 99)",), ("POINT EMPTY",), (None,), ("",), ("POLYGON ((0 0))",)]
    df = spark.createDataFrame(rows, "g string").select(point_x(F.col("g")).alias("x"), point_y(F.col("g")).alias("y"))
    got = [tuple(r) for r in df.collect()]
    assert got == [(1.0, 2.0)] * 4 + [(None, None)] * 4


def test_contains_holes_and_edges():
    o = [outline("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), outline("SRID=1;MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1)), ((5 5, 6 5, 6 6, 5 6, 5 5)))")]
    edges, first = edges_of(o)
    pts = np.array([(1, 1), (5, 5), (4, 5), (0, 3), (10, 10), (11, 1), (5.5, 5.5)], dtype=float)
    inside = [contains(np.full(len(pts), k), pts[:, 0], pts[:, 1], edges, first, chunk=5).tolist() for k in (0, 1)]
    assert inside[0] == [True, False, True, True, True, False, False]
    assert inside[1] == [True, True, False, False, False, False, True]
    assert outline("POLYGON EMPTY") is None and outline(None) is None and outline("POLYGON ((a b))") is None


def test_vantage_tree_is_complete():
    rng = np.random.default_rng(1)
    for metric, size, r in (("euclidean", 100, 3.0), ("great_circle", 1, 9000.0)):
        x, y = rng.random(700) * size, rng.random(700) * size
        x[:200], y[:200] = x[0], y[0]
        tree = VantageTree(x, y, METRICS[metric])
        i, j, _ = tree.within(x[:90], y[:90], np.full(90, r))
        d = METRICS[metric](x[:90, None], y[:90, None], x[None], y[None])
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(d <= r))))


def test_two_levels_of_pivots_lose_no_cell():
    rng = np.random.default_rng(7)
    for metric, size, most in (("euclidean", 100, 9.0), ("great_circle", 2, 30_000.0)):
        x, y = rng.random(3000) * size, rng.random(3000) * size
        pivots = Pivots(rng.random(170) * size, rng.random(170) * size, METRICS[metric])
        assert len(pivots.head_x) == 13 and pivots.first[-1] == 170
        row, cell = pivots.cells(x, y)
        home = dict(zip(row.tolist(), cell.tolist()))
        assert len(row) == 3000 and len(home) == 3000
        qx, qy, r = rng.random(60) * size, rng.random(60) * size, rng.random(60) * most
        visits = set(zip(*(v.tolist() for v in pivots.cells(qx, qy, r))))
        d = METRICS[metric](qx[:, None], qy[:, None], x[None], y[None])
        assert all((int(i), home[int(j)]) in visits for i, j in zip(*np.nonzero(d <= r[:, None])))
        assert len(visits) < 60 * 170 / 3


def test_radius_of_each_row(spark, monkeypatch):
    import gridloom.operators.near as near

    monkeypatch.setattr(near, "CELL_POINTS", 20)
    rng = np.random.default_rng(8)
    a, b = rng.random((80, 3)) * (40, 40, 6), rng.random((300, 2)) * 40
    q = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)] + [(900, 1.0, 1.0, -1.0), (901, 1.0, 1.0, None), (902, 1.0, 1.0, float("nan"))], "id long, x double, y double, r double").withColumn("cell", F.lit("clash"))
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(b)], "id long, x double, y double")
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    assert {(r.left_id, r.right_id) for r in radius_join(q, p).collect()} == set(zip(*(v.tolist() for v in np.nonzero(d <= a[:, 2:])))) 


def test_pairs_within_matches_brute_force(spark, monkeypatch):
    import gridloom.operators.near as near

    monkeypatch.setattr(near, "CELL_POINTS", 50)
    monkeypatch.setattr(near, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.random((400, 2)) * 60, 1))] + [(1000 + i, 5.0, 5.0) for i in range(150)]
    rows = [*pts, pts[0], (7000, None, 1.0), (7001, float("nan"), 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").withColumn("cell", F.lit("clash"))
    got = pairs_within(df, 2.5).collect()
    a = np.array(pts)
    d = np.hypot(a[:, None, 1] - a[None, :, 1], a[:, None, 2] - a[None, :, 2])
    want = {(int(a[i, 0]), int(a[j, 0])) for i, j in zip(*np.nonzero(d <= 2.5 + 1e-9)) if a[i, 0] < a[j, 0]}
    assert len(got) == len(want) and {(r.left_id, r.right_id) for r in got} == want


def test_limit_is_inclusive_and_empty_sides(spark):
    df = spark.createDataFrame([(1, 253541.123, 0.0), (2, 253542.623, 2.0)], "id long, x double, y double")
    assert pairs_within(df, 2.5).count() == 1
    assert pairs_within(df.limit(0), 2.5).count() == 0
    assert radius_join(df.withColumn("r", F.lit(1.0)), df.limit(0)).count() == 0


def test_points_in_outlines(spark):
    segs = spark.createDataFrame([(1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), (2, "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))"), (2, "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))"), (3, None), (4, "POLYGON EMPTY")], "segment_id long, geometry string")
    pts = spark.createDataFrame([(10, 4.0, 2.0), (11, 1.0, 1.0), (12, 9.0, 9.0), (12, 9.0, 9.0), (13, None, None)], "id long, x double, y double")
    got = points_in_outlines(pts, outlines(segs, "segment_id", "geometry")).collect()
    assert sorted((r.point_id, r.segment_id) for r in got) == [(10, 1), (10, 2), (11, 1)]


def test_batch_reading_equals_one_by_one():
    texts = [
        "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,2 2,1 1))", "SRID=3;MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1)))",
        "polygon ( ( 1.50 2e3 , 4 4 , 0 4 , 1.50 2e3 ) )", "POLYGON ((0 0, 4 0, 4 4))", "POLYGON Z ((0 0 1, 4 0 1, 4 4 1, 0 0 1))", "POLYGON ((0 0 1, 4 0 1, 4 4 1, 0 0 1))", "POLYGON EMPTY", None, "", "POINT (1 2)", "POLYGON ()", "POLYGON (())", "POLYGON ((x y))",
    ]
    for chosen in (texts, texts[:4], texts[4:], texts[:1], [], [*texts, "POLYGON ((1 2, 3 4 5, 1 2))"], ["POLYGON ((1 2, 3-4 5, 1 2))", texts[0]]):
        for a, b in zip(parse_outlines(chosen), map(outline, chosen), strict=True):
            assert (a is None) == (b is None) and (a is None or np.array_equal(a, b, equal_nan=True))
