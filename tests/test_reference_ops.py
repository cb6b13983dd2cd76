import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.common import latest, ranked
from gridloom.operators import classify, cost, detect, graph, neighbours, raster, seeds, segment, spatial, zonal
from gridloom.operators.segment import _local_regions


def pixels(spark, a, value="v"):
    rows = [(1, int(r), int(c), None if np.isnan(x) else float(x)) for (r, c), x in np.ndenumerate(np.asarray(a, float))]
    return spark.createDataFrame(rows, f"raster_id long, row int, col int, {value} double")


def dense(df, shape, value):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[value] is not None:
            out[r.row, r.col] = r[value]
    return out


def test_latest_and_ranked(spark):
    df = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, None, "b"), (1, 2, None, "b"), (1, None, 9, "c"), (2, None, 1, "d"), (None, 3, 3, "e")], "k long, t int, v int, clash string")
    assert {tuple(r) for r in latest(df, "k", ["t"], ["v"]).collect()} == {(1, None), (2, 1)}
    big = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").alias("g"))
    rows = ranked(big, ["g"], F.xxhash64("id"), ["id"]).collect()
    assert sorted(r["rank"] for r in rows if r.g == "hot") == list(range(1, 4001))
    assert sorted(r["rank"] for r in rows if r.g is None) == list(range(1, 1001))


def test_gaussian_and_tiles_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.random((37, 23))
    radius, w = 4, neighbours.gaussian_weights(1.0, 4)
    p = np.pad(a, radius, mode="symmetric")
    want = np.array([[(p[r : r + 9, c : c + 9] * np.outer(w, w)).sum() for c in range(23)] for r in range(37)])
    for tile in (8, 64):
        got = dense(neighbours.gaussian(pixels(spark, a), 1.0, tile=tile), a.shape, "v")
        assert np.allclose(got, want)


def test_entropy_bounds_and_missing(spark):
    a = np.tile(np.arange(12.0), (12, 1))
    a[3, 3] = np.nan
    got = dense(neighbours.entropy(pixels(spark, a, "v8"), tile=5), a.shape, "entropy")
    near = [a[6 + r, 6 + c] for r, c in neighbours.DISK_3]
    _, n = np.unique([x for x in near if not np.isnan(x)], return_counts=True)
    q = n / n.sum()
    assert math.isclose(got[6, 6], -(q * np.log2(q)).sum())
    flat = dense(neighbours.entropy(pixels(spark, np.ones((6, 6)), "v8")), (6, 6), "entropy")
    assert (flat == 0).all()


def test_plateau_and_sobel(spark):
    a = np.zeros((6, 6))
    a[2, 2] = a[2, 3] = 5
    assert {(r.row, r.col) for r in neighbours.local_maxima(pixels(spark, a), 2, 1).collect()} == {(2, 2), (2, 3)}
    p = np.pad(a, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    assert np.allclose(dense(neighbours.sobel(pixels(spark, a)), a.shape, "gradient"), np.hypot(gx, gy))


@pytest.mark.parametrize(("sketch", "small"), [(10_000, 0), (50, 0), (10_000, 1 << 62)])
def test_percentiles_are_exact(spark, monkeypatch, sketch, small):
    monkeypatch.setattr(raster, "SKETCH", sketch)
    monkeypatch.setattr(raster, "ONE_TASK_BYTES", small)
    rng = np.random.default_rng(12)
    groups = {"a": rng.normal(0, 1, 3000), "b": np.round(rng.normal(0, 2, 2500)), "c": np.array([5.0]), "d": np.array([1.0, 2.0]), "e": np.full(700, 3.0), "f": rng.random(60), "g": rng.random(101)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    ps = [0.02, 0.25, 0.5, 0.98]
    got = {r.g: r["_p"] for r in raster.exact_percentiles(df, ["g"], "v", ps).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose(got[g], np.percentile(v, [100 * p for p in ps]), atol=1e-12), g
    whole = raster.exact_percentiles(df, [], "v", [0.5]).collect()
    assert math.isclose(whole[0]["_p"][0], np.median(np.concatenate(list(groups.values()))))


def test_flat_bands(spark):
    px = pixels(spark, np.full((4, 4), 7.0))
    assert {r.v8 for r in raster.rescale_to_8bit(px).collect()} == {0}
    assert {r.v for r in raster.normalize_band(px).collect()} == {None}
    assert {r.n for r in raster.percentile_normalise(px).collect()} == {0.0}
    got = {r.equalized for r in raster.equalize(px.withColumn("g", F.lit(9)), "g").collect()}
    assert got == {9}
    with pytest.raises(IndexError):
        raster.select_bands(px, [3], 3)
    with pytest.raises(ValueError):
        raster.to_image(px, "other")


def test_glcm_of_masked_segment(spark):
    a = np.array([[1.0, 5, 9], [2, np.nan, 3], [4, 4, 8]])
    rows = [(7, int(r), int(c), float(x)) for (r, c), x in np.ndenumerate(a) if not np.isnan(x)]
    px = spark.createDataFrame([*rows, (8, 0, 0, 1.0), (9, 0, 0, None)], "segment_id long, row int, col int, v double")
    got = {r.segment_id: r for r in zonal.textural_stats(px).collect()}
    q = (np.nan_to_num(a) / 9 * 255).astype(int)
    per = []
    for dr, dc in zonal.OFFSETS:
        m = np.zeros((256, 256))
        for r in range(3):
            for c in range(3):
                if 0 <= r + dr < 3 and 0 <= c + dc < 3:
                    m[q[r, c], q[r + dr, c + dc]] += 1
                    m[q[r + dr, c + dc], q[r, c]] += 1
        p = m / m.sum()
        assert math.isclose(p.sum(), 1) and (p == p.T).all()
        i, j = np.indices(p.shape)
        mu = (p * i).sum()
        var = (p * (i - mu) ** 2).sum()
        per.append([(p * (i - j) ** 2).sum(), (p * abs(i - j)).sum(), (p / (1 + (i - j) ** 2)).sum(), (p * p).sum(), math.sqrt((p * p).sum()), 1.0 if var < 1e-15 else (p * (i - mu) * (j - mu)).sum() / var])
    assert np.allclose([got[7][s] for s in zonal.TEXTURAL], np.mean(per, axis=0))
    tiled = {r.segment_id: r for r in zonal.textural_stats(px, tile=2).collect()}
    assert np.allclose([tiled[7][s] for s in zonal.TEXTURAL], np.mean(per, axis=0))
    assert set(got) == {7}
    assert zonal.feature_columns([0, 2], ("mean",), [2], ("contrast",)) == ["segment_id", "b0_mean", "b2_mean", "b2_contrast"]
    with pytest.raises(NotImplementedError):
        zonal.structural_stats()


def test_texture_of_overlapping_boxes_across_tiles(spark, monkeypatch):
    rng = np.random.default_rng(31)
    rows = [(f"k{s}", None if s == 2 else "x", int(r), int(c), float(rng.integers(-5, 30))) for s in range(5) for r, c in np.unique(rng.integers(s, s + 14, (60, 2)), axis=0)]
    px = spark.createDataFrame(rows, "k string, g string, row int, col int, v double")
    want = {r.k: r for r in zonal.textural_stats(px, ["k", "g"]).collect()}
    for s in range(5):
        mine = [r for r in rows if r[0] == f"k{s}"]
        r0, c0 = min(r[2] for r in mine), min(r[3] for r in mine)
        a = np.zeros((max(r[2] for r in mine) - r0 + 1, max(r[3] for r in mine) - c0 + 1))
        for r in mine:
            a[r[2] - r0, r[3] - c0] = r[4]
        low, high = min(0, a.min()), max(0, a.max())
        q = ((a - low) / (high - low) * 255).astype(int)
        contrast = []
        for dr, dc in zonal.OFFSETS:
            i = q[: q.shape[0] - dr, max(0, -dc) : q.shape[1] - max(0, dc)]
            j = q[dr:, max(0, dc) : q.shape[1] + min(0, dc)]
            contrast.append(((i - j) ** 2).mean())
        assert math.isclose(want[f"k{s}"].contrast, np.mean(contrast), rel_tol=1e-9)
    monkeypatch.setattr(zonal, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(zonal, "CELLS_AT_ONCE", 50)
    for r in zonal.textural_stats(px, ["k", "g"], tile=4).collect():
        assert np.allclose([r[s] for s in zonal.TEXTURAL], [want[r.k][s] for s in zonal.TEXTURAL])


@pytest.mark.parametrize("finish", [2_000_000, 0])
def test_components_against_union_find(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH_EDGES", finish)
    monkeypatch.setattr(graph, "LOCAL_EDGES", 40)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3), (5, 5)]
    nodes = [*range(300), *range(1000, 1101)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    got = graph.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {n: find(n) for n in nodes}
    keyed = [(k, a, b) for a, b in edges for k in ("x", "y") if k == "x" or a != 1040]
    got = graph.components(spark.createDataFrame([(k, n) for n in nodes for k in ("x", "y")], "k string, id long"), spark.createDataFrame(keyed, "k string, a long, b long"), keys=["k"])
    found = {(r.k, r.id): r.component for r in got.collect()}
    assert all(found["x", n] == find(n) for n in nodes) and all(found["y", n] == (1041 if n > 1040 else find(n)) for n in nodes)


@pytest.mark.parametrize("finish", [2_000_000, 0])
def test_survivors_against_a_loop(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH_EDGES", finish)
    rng = np.random.default_rng(6)
    edges = [(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (80, 2)) if a != b] + [(i, i + 1) for i in range(100, 106)]
    nodes, kept = [*range(60), *range(100, 107)], []
    for n in nodes:
        if not any((w, n) in set(edges) for w in kept):
            kept.append(n)
    got = graph.survivors(spark.createDataFrame([(n, "z") for n in nodes], "id long, winner string"), spark.createDataFrame(edges, "winner long, loser long"))
    assert sorted(r.id for r in got.collect()) == kept


def test_small_regions_are_merged(spark):
    rng = np.random.default_rng(9)
    a = np.kron(np.arange(6).reshape(2, 3), np.ones((8, 8)))
    a[rng.random(a.shape) < 0.15] = 9
    out = dense(segment.enforce_connectivity(pixels(spark, a, "label"), 20), a.shape, "region")
    for v in np.unique(out):
        assert (out == v).sum() >= 20 and len(np.unique(_local_regions(np.where(out == v, 1.0, np.nan))[out == v])) == 1
    lone = segment.enforce_connectivity(pixels(spark, np.ones((2, 2)), "label"), 20)
    assert lone.count() == 4


def test_regions_across_tiles_and_outlines(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, (19, 17)).astype(float)
    whole = _local_regions(a)
    got = dense(segment.connected_regions(pixels(spark, a, "label"), tile=5), a.shape, "region")
    assert (got == whole).all()
    regions = segment.connected_regions(pixels(spark, a, "label"), tile=7)
    from gridloom.functions.wkt import outline

    for r in segment.outlines_wkt(regions).collect():
        o = outline(r.geometry)
        area, start = 0.0, 0
        for stop in [*np.flatnonzero(np.isnan(o[:, 0])), len(o)]:
            x, y = o[start:stop].T
            area += (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2
            start = stop + 1
        assert abs(area) == (whole == r.region).sum()


def test_slic_finds_flat_rectangles(spark):
    a = np.zeros((24, 24))
    a[:, 12:], a[12:] = 100, a[12:] + 300
    px = pixels(spark, a)
    out = dense(segment.slic(px, ["v"], 16, compactness=1.0), a.shape, "label")
    labels = segment.slic_array(a[None], 16, 1.0)
    for lab in (out, labels):
        for v in np.unique(lab):
            assert len(np.unique(a[lab == v])) == 1
    masked = px.where("col < 20").withColumn("v", F.when(F.col("row") > 1, F.col("v")))
    assert segment.slic(masked, ["v"], 9, iterations=2).count() == 22 * 20


def test_shapley_values_of_few_features_are_exact(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 5.0, 7.0)], "segment_id long, f0 double, f1 double, f2 double, f3 double")
    product = lambda x: np.stack([x[:, 0] * x[:, 1] * x[:, 2], x[:, 3] - x[:, 0]], axis=1)
    for seed in (1, 2):
        got = {(r.class_no, r.feature): r.value for r in classify.shapley_values(df, "segment_id", ["f0", "f1", "f2", "f3"], product, [0.0] * 4, 4, seed).collect()}
        want = {(0, "f0"): 10, (0, "f1"): 10, (0, "f2"): 10, (0, "f3"): 0, (1, "f0"): -2, (1, "f1"): 0, (1, "f2"): 0, (1, "f3"): 7}
        assert got == pytest.approx(want)


def test_classified_raster_has_all_segments(spark, tmp_path):
    from gridloom.plans.reference import QUERIES

    labels = spark.createDataFrame([(7, 1, 0, 0), (7, 1, 0, 1), (8, 1, 1, 0)], "segment_id long, raster_id long, row int, col int")
    got = classify.classified_raster(labels, spark.createDataFrame([(7, 3), (9, 4)], "segment_id long, predicted_class int")).collect()
    assert {(r.row, r.col, r.v) for r in got} == {(0, 0, 3.0), (0, 1, 3.0), (1, 0, None)}
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding"), (F.col("id") % 5).cast("int").alias("label"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = QUERIES["classified_raster"](spark, str(tmp_path)).collect()
    assert len(out) == 400 * 64 and all(r.v == (r.row // 20 * 8 + r.col // 8) % 5 for r in out)


def test_slic_labels_pixels_that_no_centre_reaches(spark):
    # step 10: the two pixels between join one side each, whose centres then move two cells away
    a = np.full((10, 70), np.nan)
    a[5, 35], a[5, 45], a[1:9, 54:57], a[1:9, 51:54] = 0, 0, 0, 1000
    a[5, 34], a[5, 25], a[1:9, 14:17], a[1:9, 17:20] = 100, 100, 100, 1000
    px = pixels(spark, a).where("v is not null")
    assert px.count() == 100
    out = segment.slic(px, ["v"], 1, compactness=0.1, iterations=3)
    assert out.count() == 100
    lab = dense(out, a.shape, "label")
    assert lab[5, 35] == lab[5, 45] == lab[1, 54] and lab[5, 34] == lab[5, 25] == lab[1, 14]
    assert len(np.unique(lab[~np.isnan(lab)])) == 4


def test_quickshift_and_tiled_cover_all_pixels(spark):
    rng = np.random.default_rng(3)
    a = np.kron([[0.0, 50], [100, 150]], np.ones((20, 20))) + rng.random((40, 40))
    q = dense(segment.quickshift(pixels(spark, a), ["v"], 1.5, 4), a.shape, "label")
    assert not np.isnan(q).any()
    blocks = np.kron([[0, 1], [2, 3]], np.ones((20, 20)))
    assert all(len(np.unique(blocks[q == v])) == 1 for v in np.unique(q))
    t = segment.tiled_segments(pixels(spark, a), ["v"], tile=16, buffer=4, crown_radius=3)
    assert t.count() == t.select("row", "col").distinct().count() == 1600
    with pytest.raises(ValueError):
        segment.tiled_segments(pixels(spark, a), ["v"], tile=10, buffer=6)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=8, max_size=8))
def test_iou_is_symmetric(v):
    def area(b):
        return (b[2] - b[0]) * (b[3] - b[1])

    a = (min(v[0], v[1]), min(v[2], v[3]), max(v[0], v[1]), max(v[2], v[3]))
    b = (min(v[4], v[5]), min(v[6], v[7]), max(v[4], v[5]), max(v[6], v[7]))
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    iou = w * h / (area(a) + area(b) - w * h + 1e-6)
    assert 0 <= iou <= 1


def _iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h + 1e-6)


def test_patches_and_prediction(spark):
    a = np.zeros((20, 26))
    a[3:6, 4:9] = a[12:15, 10:16] = 1
    px = pixels(spark, a).withColumn("band", F.lit(0))
    patches = {(r.row0, r.col0): r for r in detect.patch_arrays(px, 12, 4).collect()}
    assert set(patches) == {(r, c) for r in (0, 8, 16) for c in (0, 8, 16, 24)}
    for (r0, c0), r in patches.items():
        assert np.array_equal(np.array(r.pixels).reshape(r.height, r.width), a[r0 : r0 + 12, c0 : c0 + 12])

    def model(x):
        rows, cols = np.nonzero(x[0] > 0.5)
        full = len(rows) and rows.min() > 0 and cols.min() > 0 and rows.max() + 1 < x.shape[1] and cols.max() + 1 < x.shape[2]
        return (np.array([[cols.min(), rows.min(), cols.max() + 1, rows.max() + 1]]), np.array([0.9]), np.array([1])) if full else (np.zeros((0, 4)), np.zeros(0), np.zeros(0))

    got = {(r.x0, r.y0, r.x1, r.y1) for r in detect.predict_patches(px, model, 12, 8).collect()}
    assert got == {(4, 3, 9, 6), (10, 12, 16, 15)}


def test_box_join_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    xy = rng.integers(-20, 60, (120, 2)).astype(float)
    wh = rng.integers(0, 15, (120, 2)).astype(float)
    rows = [(i, 0, *map(float, p), *map(float, p + s), float(i)) for i, (p, s) in enumerate(zip(xy, wh))]
    df = spark.createDataFrame(rows, "box_id long, image_id long, x0 double, y0 double, x1 double, y1 double, score double")
    for how, op in (("touch", np.less_equal), ("overlap", np.less)):
        got = [(r.box_id, r.r_box_id) for r in spatial.box_join(df, df, 7, how=how).collect()]
        want = {(a[0], b[0]) for a in rows for b in rows if op(a[2], b[4]) and op(b[2], a[4]) and op(a[3], b[5]) and op(b[3], a[5])}
        assert len(got) == len(set(got)) and set(got) == want
    kept = detect.box_nms(df, 7, 0.3).collect()
    order, want = sorted(rows, key=lambda r: (-r[6], r[0])), []
    for a in order:
        if all(_iou(a[2:6], b[2:6]) <= 0.3 for b in want):
            want.append(a)
    assert {r.box_id for r in kept} == {a[0] for a in want}
    for a in kept:
        for b in kept:
            if a.box_id < b.box_id:
                w, h = max(0, min(a.x1, b.x1) - max(a.x0, b.x0)), max(0, min(a.y1, b.y1) - max(a.y0, b.y0))
                union = (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - w * h
                assert w * h / (union + 1e-6) <= 0.3


def test_assignment_prefers_area_then_border(spark):
    items = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 10.0, 0.0, 12.0, 2.0), (3, 50.0, 50.0, 51.0, 51.0)], "item_id long, x0 double, y0 double, x1 double, y1 double")
    zones = spark.createDataFrame([(7, 1.0, 0.0, 3.0, 2.0), (8, 1.5, 0.0, 9.0, 2.0), (9, 12.0, 0.0, 13.0, 1.0), (4, 12.0, 0.0, 13.0, 2.0)], "fid long, x0 double, y0 double, x1 double, y1 double")
    got = {r.item_id: (r.fid, r.area) for r in spatial.assign_by_overlap(items, zones, 5).collect()}
    assert got == {1: (7, 2.0), 2: (4, 0.0), 3: (None, 0.0)}


def test_nms_variants(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(x), float(y), float(h), 1) for i, (x, y, h) in enumerate(rng.random((80, 3)) * [10, 10, 20])]
    df = spark.createDataFrame(pts, "id long, x double, y double, height double, root long")
    order = sorted(pts, key=lambda p: (-p[3], p[0]))
    r = lambda p: max(0.5, 0.1 * p[3])
    coded = {p[0] for i, p in enumerate(order) if not any(math.hypot(p[1] - q[1], p[2] - q[2]) <= r(q) for q in order[i + 1 :])}
    assert {x.id for x in seeds.nms_coded(df, 0.5, 0.1, ["root"], 2.0).collect()} == coded
    greedy = []
    for p in order:
        if all(math.hypot(p[1] - q[1], p[2] - q[2]) > r(q) for q in greedy):
            greedy.append(p)
    assert {x.id for x in seeds.nms_greedy(df, 0.5, 0.1, "root", 2.0).collect()} == {p[0] for p in greedy}
    assert seeds.nms_coded(df, 0, 0, ["root"], 1.0).count() == 80
    for z in (-1, 12):
        taken: dict[int, int] = {}
        for p in pts:
            ball = [q for q in pts if math.hypot(p[1] - q[1], p[2] - q[2]) <= min(max(0.1 * p[3], 0.5), 1.5)]
            if p[0] in taken or (z >= 0 and max(q[3] for q in ball) - min(q[3] for q in ball) > z) or len(ball) < 2:
                continue
            taken |= {q[0]: p[0] for q in ball}
        assert {x.id: x.cluster1 for x in seeds.ball_clusters(df, 0.1, 0.5, 1.5, z).collect()} == {p[0]: taken.get(p[0]) for p in pts}


def test_points_sample_their_own_raster(spark):
    px = spark.createDataFrame([(k, r, c, float(100 * k + 10 * r + c)) for k in (1, 2) for r in range(3) for c in range(4)], "raster_id long, row int, col int, v double")
    pts = spark.createDataFrame([(1, 1, 1000.4, 49.9), (2, 2, 1000.4, 49.9), (3, 2, 1001.9, 48.6), (4, 1, 999.9, 49.0), (5, 3, 1000.1, 49.9), (6, 1, None, 1.0)], "id long, raster_id long, x double, y double")
    got = {r.id: r.sampled for r in spatial.sample_raster(pts, px, (0.5, 0, 1000, 0, -0.5, 50)).collect()}
    assert got == {1: 100.0, 2: 200.0, 3: 223.0}


def test_classification_pieces(spark):
    rows = [(i, float(i % 7), float(i % 3), 5.0, i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "segment_id long, f0 double, f1 double, f2 double, feature_class int")
    s = classify.split(df, "segment_id", 0.25)
    assert s.where("is_test").count() == 23
    scaled = classify.scale(df, ["f0", "f1", "f2"])
    m = scaled.agg(F.avg("f0"), F.stddev_pop("f0"), F.max(F.abs("f2"))).first()
    assert abs(m[0]) < 1e-9 and abs(m[1] - 1) < 1e-9 and m[2] == 0
    model = classify.fit(df, ["f0", "f1", "f2"], "rf", n_estimators=5, max_depth=3)
    out = classify.predict(model, df)
    c, margin = classify.choose(F.col("proba"), classify.class_labels(model), F.lit(None).cast("array<int>"))
    got = out.select("feature_class", c.alias("c"), margin.alias("m")).collect()
    assert np.mean([r.c == r.feature_class for r in got]) > 0.95 and all(r.m >= 0 for r in got)
    votes = classify.forest_votes(model)
    x = np.array([r[1:4] for r in rows])
    assert np.mean(votes(x).argmax(axis=1) == [r[4] for r in rows]) > 0.95
    shap = classify.shapley_values(df, "segment_id", ["f0", "f1", "f2"], votes, [0.0, 0.0, 5.0], 3).groupBy("segment_id", "class_no").agg(F.sum("value").alias("v")).collect()
    base, full = votes(np.array([[0.0, 0.0, 5.0]])), votes(x)
    assert all(abs(r.v - (full[r.segment_id, r.class_no] - base[0, r.class_no])) < 1e-9 for r in shap)
    one, none = F.array(F.lit(1)), F.array(F.lit(77))
    r = out.limit(1).select(*classify.choose(F.col("proba"), [0, 1, 2], one), *classify.choose(F.col("proba"), [0, 1, 2], none)).first()
    assert r[0] == 1 and r[1] is None and r[2] is None and r[3] is None
    with pytest.raises(ValueError):
        classify.fit(df, ["f0"], "svm")


def test_empty_inputs(spark):
    px = pixels(spark, np.ones((2, 2))).limit(0)
    assert neighbours.gaussian(px, 1.0).count() == 0
    assert raster.rescale_to_8bit(px).count() == 0
    assert zonal.textural_stats(px.withColumn("segment_id", F.lit(1))).count() == 0
    pts = spark.createDataFrame([], "id long, x double, y double, height double")
    assert spatial.neighbours(pts, 1.0).count() == 0
    assert graph.components(pts, spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(ValueError):
        cost.cost_surface(px, px, None, (1, 1, 1, 1))
    with pytest.raises(ValueError):
        raster.tile_grid(px, 0, 1)


def test_augmentation_keeps_boxes_inside(spark):
    b = spark.createDataFrame([(i, i, 1.0, 2.0, 11.0, 22.0, 100.0, 50.0) for i in range(40)], "box_id long, image_id long, x0 double, y0 double, x1 double, y1 double, width double, height double")
    rows = detect.augment(b, 3).collect()
    assert {(r.rotated, r.flipped) for r in rows} == {(a, b) for a in (True, False) for b in (True, False)}
    for r in rows:
        assert 0 <= r.x0 < r.x1 <= r.width and 0 <= r.y0 < r.y1 <= r.height
        assert sorted((r.x1 - r.x0, r.y1 - r.y0)) == [10, 20]
    assert all((r.x0, r.y1) == (1, 22) for r in detect.augment(b, 3, train=False).collect())


def test_neighbours_are_not_broadcast(spark, tmp_path):
    spark.range(500).selectExpr("id", "double(id % 20) x", "double(id div 20) y").write.parquet(f"{tmp_path}/p")
    pairs = spatial.neighbours(spark.read.parquet(f"{tmp_path}/p"), 1.05)
    assert pairs.count() == 20 * 24 + 19 * 25
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def shared_places(spark, n=150, side=6, seed=3):
    """Seeds of which many stand at the same place, two off the map."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), float(x) / 2, float(y) / 2, float(h), int(k)) for i, (x, y, h, k) in zip(rng.permutation(n), np.column_stack([rng.integers(0, side, (n, 2)), rng.integers(1, 30, n), rng.integers(0, 2, n)]))]
    rows += [(n, None, 1.0, 9.0, 0), (n + 1, float("nan"), 1.0, 9.0, 1)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, height double, root long")


def apart(p, q):
    return math.inf if p[1] is None or q[1] is None or math.isnan(p[1] + q[1]) else math.hypot(p[1] - q[1], p[2] - q[2])


def test_ball_clusters_of_shared_places(spark, monkeypatch):
    rows, df = shared_places(spark)
    sizes = []
    monkeypatch.setattr(seeds, "checkpoint", lambda d, keep=seeds.checkpoint: [c := keep(d), sizes.append(c.count())][0])
    for least, z in ((2, -1), (1, -1), (2, 25), (9, 20)):
        taken: dict[int, int] = {}
        for p in sorted(rows):
            ball = [q for q in rows if q[0] == p[0] or apart(p, q) <= min(max(0.05 * p[3], 0.3), 0.8)]
            if p[0] not in taken and len(ball) >= least and not (z >= 0 and max(q[3] for q in ball) - min(q[3] for q in ball) > z):
                taken |= {q[0]: p[0] for q in ball}
        got = seeds.ball_clusters(df, 0.05, 0.3, 0.8, z, least).collect()
        assert {x.id: x.cluster1 for x in got} == {p[0]: taken.get(p[0]) for p in rows}
    assert max(sizes) < 1500  # balls of places; pairs of seeds would be over 2,000


def test_canonical_seeds_of_shared_places(spark, monkeypatch):
    rows, df = shared_places(spark, side=9)
    paired = []
    monkeypatch.setattr(seeds, "neighbours", lambda p, *a, keep=seeds.neighbours, **k: [keep(p, *a, **k), paired.append(p.count())][0])
    px = spark.createDataFrame([(k, r, c, ((r * 7 + c * 3 + k) % 10) / 10) for k in (0, 1) for r in range(6) for c in range(5)], "root long, row int, col int, cost double")
    df = df.withColumnRenamed("root", "raster_id")
    pairs = spatial.neighbours(df, 1.05, ["raster_id"]).where("raster_id = o_raster_id")
    close = seeds.effective_distance(pairs, px.withColumnRenamed("root", "raster_id"), 6, 5, keys=["raster_id"]).where("d_eff <= 1.05").collect()
    root = {p[0]: p[0] for p in rows}
    for _ in rows:
        for e in close:
            root[e.id] = root[e.other] = min(root[e.id], root[e.other])
    out = seeds.canonical_seeds(df.where("id % 2 = 0"), df.where("id % 2 = 1"), px.withColumnRenamed("root", "raster_id"), 6, 5, 1.05, keys=["raster_id"])
    assert {r.id: r.cluster for r in out.collect()} == {i: 2 * r for i, r in root.items()}
    assert paired == [len({(p[1], p[2], p[4]) for p in rows[:-2]})] and paired[0] < len(rows) - 2


def test_components_of_shared_places(spark):
    rows, df = shared_places(spark, side=14)
    edges = spatial.links(df, 0.6)
    want = {p[0]: p[0] for p in rows}
    for _ in rows:
        for p in rows:
            want[p[0]] = min([want[p[0]], *(want[q[0]] for q in rows if apart(p, q) <= 0.6)])
    got = graph.components(df, edges.selectExpr("id a", "other b")).collect()
    assert {r.id: r.component for r in got} == want
    assert edges.count() < spatial.neighbours(df, 0.6).count()


@pytest.mark.parametrize("kind", ["coded", "greedy"])
def test_suppression_of_shared_places(spark, kind):
    rows, df = shared_places(spark, side=12)
    order, r, off = sorted(rows, key=lambda p: (-p[3], p[0])), lambda p: max(0.4, 0.05 * p[3]), {p[0] for p in rows[-2:]}
    if kind == "coded":
        want = {p[0] for i, p in enumerate(order) if not any(q[4] == p[4] and apart(p, q) <= r(q) for q in order[i + 1 :])}
        got = seeds.nms_coded(df, 0.4, 0.05, ["root"], 1.5)
    else:
        kept = []
        for p in order:
            if all(q[4] != p[4] or apart(p, q) > r(q) for q in kept):
                kept.append(p)
        want, got = {p[0] for p in kept}, seeds.nms_greedy(df, 0.4, 0.05, "root", 1.5)
    assert {x.id for x in got.collect()} == want and off <= want
    left, lost = seeds._outlived(df, 0.4, 0.05, ["root"], [F.col("height").desc(), F.col("id")])
    assert left.count() == len({(p[1], p[2], p[4]) for p in rows[:-2]}) + 2 and left.count() + lost.count() == len(rows)


def test_effective_pairs_of_shared_places(spark):
    _, df = shared_places(spark, side=9)
    df, cost = df.withColumnRenamed("root", "raster_id"), spark.createDataFrame([(k, r, c, ((r * 7 + c * 3 + k) % 10) / 10) for k in (0, 1) for r in range(6) for c in range(5)], "raster_id long, row int, col int, cost double")
    pairs = spatial.neighbours(df, 1.2, ["raster_id"]).where("raster_id = o_raster_id")
    want = {(r.id, r.other): r.d_eff for r in seeds.effective_distance(pairs, cost, 6, 5, keys=["raster_id"]).collect()}
    got = {(r.id, r.other): r.d_eff for r in seeds.effective_pairs(df, cost, 6, 5, 1.2, keys=["raster_id"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want) and len(want) > 500


def test_distances_of_shared_places_are_counted(spark):
    rows, df = shared_places(spark)
    d = sorted(x for i, p in enumerate(rows) for q in rows[i + 1 :] if (x := apart(p, q)) <= 1.3)
    counts = spatial.distance_counts(df, 1.3)
    assert counts.agg(F.sum("pairs")).first()[0] == len(d) and counts.count() == len(set(d))
    ps = [0.0, 0.1, 0.37, 0.5, 1.0]
    assert np.allclose(raster.counted_percentiles(counts, "d", "pairs", ps).first()[0], np.quantile(d, ps))
    assert raster.counted_percentiles(counts.limit(0), "d", "pairs", [0.5]).first()[0] == [None]


def crowded_boxes(spark, n=90):
    rng = np.random.default_rng(8)
    rows = [(i, int(k), float(x), float(y), float(x + w), float(y + h), float(s)) for i, (k, x, y, w, h, s) in enumerate(np.column_stack([rng.integers(0, 2, n), rng.integers(0, 12, (n, 2)), rng.integers(1, 9, (n, 2)), rng.integers(0, 9, n)]))]
    return rows, spark.createDataFrame(rows, "box_id long, image_id long, x0 double, y0 double, x1 double, y1 double, score double")


def shared_part(p, q):
    w, h = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
    both = max(w, 0) * max(h, 0)
    return both / ((p[4] - p[2]) * (p[5] - p[3]) + (q[4] - q[2]) * (q[5] - q[3]) - both + 1e-6)


@pytest.mark.parametrize(("block", "pairs"), [(2000, 200_000), (7, 5)])
def test_iou_pairs_of_crowded_cells(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(detect, "BLOCK_BOXES", block)
    monkeypatch.setattr(detect, "PAIRS_AT_ONCE", pairs)
    rows, df = crowded_boxes(spark)
    for least in (0.0, 0.3):
        got = [(r.box_id, r.r_box_id, r.iou) for r in detect.iou_pairs(df, 5, least).collect()]
        want = [(p[0], q[0], s) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and (s := shared_part(p, q)) > least]
        assert sorted(got) == want


@pytest.mark.parametrize("finish", [1_000_000, 20])
def test_box_nms_pairs_the_rest_again(spark, monkeypatch, finish):
    monkeypatch.setattr(detect, "FINISH_EDGES", finish)
    rows, df = crowded_boxes(spark)
    kept = []
    for p in sorted(rows, key=lambda p: (-p[6], p[0])):
        if all(p[1] != q[1] or shared_part(p, q) <= 0.2 for q in kept):
            kept.append(p)
    assert {r.box_id for r in detect.box_nms(df, 5, 0.2).collect()} == {p[0] for p in kept}


@pytest.mark.parametrize(("block", "pairs"), [(2000, 200_000), (3, 5)])
def test_best_overlaps_of_repeated_zones(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(spatial, "BLOCK_BOXES", block)
    monkeypatch.setattr(spatial, "PAIRS_AT_ONCE", pairs)
    rows, df = crowded_boxes(spark)
    zones = [(k, float(k % 4 * 3), float(k % 3 * 3), float(k % 4 * 3 + 3), float(k % 3 * 3 + 3)) for k in range(40)]
    z = spark.createDataFrame(zones, "fid long, x0 double, y0 double, x1 double, y1 double")
    items = df.selectExpr("box_id item_id", "x0", "y0", "x1", "y1")

    def best(p):
        found = []
        for f, a, b, c, e in zones:
            w, h = min(p[4], c) - max(p[2], a), min(p[5], e) - max(p[3], b)
            if w >= 0 and h >= 0:
                found.append((-w * h, -max(w, h) if w * h == 0 else 0.0, f))
        return (min(found)[2], -min(found)[0]) if found else (None, 0.0)

    got = {r.item_id: (r.fid, r.area) for r in spatial.assign_by_overlap(items, z, 5).collect()}
    assert got == {p[0]: best(p) for p in rows}
