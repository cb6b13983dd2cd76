import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.common import local_path
from gridloom.sources.geotiff import Header, catalog, files_of, read_geotiff, read_mask, write_geotiff
from gridloom.sources.gpkg import read_gpkg, wkb_to_wkt, wkt_to_wkb, write_gpkg

GT = (0.5, 0.0, 200000.0, 0.0, -0.5, 1000000.0)


def test_geotiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2000, (3, 70, 45)).astype(float)
    rows = [(rid, b, r, c, float(x)) for rid in (1, 2) for (b, r, c), x in np.ndenumerate(a) if not (r == 5 and c == 6)] + [(1, 0, 5, 6, None)]
    df = spark.createDataFrame(rows, "raster_id long, band int, row int, col int, v double")
    for kind, compress in (("float32", True), ("int16", False)):
        folder = str(tmp_path / kind)
        paths = [r.path for r in write_geotiff(df, folder, GT, 32604, kind, compress=compress, tile=32).collect()]
        assert len(paths) == 2
        h = Header(sorted(paths)[0])
        assert (h.width, h.height, h.bands, h.crs, h.gt, h.nodata) == (45, 70, 3, "EPSG:32604", GT, -9999.0)
        got = read_geotiff(spark, paths[0]).collect()
        assert len(got) == 3 * 70 * 45
        for r in got:
            assert r.v == (None if (r.row, r.col) == (5, 6) else a[r.band, r.row, r.col])
        part = read_geotiff(spark, paths[0], bands=[1], window=(10, 40, 3, 9)).where(F.col("row") < 20)
        assert part.count() == 10 * 6 and {r.band for r in part.collect()} == {1}
        assert catalog(spark, paths).where("n_bands = 3").count() == 2
    assert read_mask(spark, paths[0]).count() == int((a[0] != 0).sum()) - (a[0][5, 6] != 0)


def test_gpkg_round_trip(spark, tmp_path):
    shapes = ["POINT (1.5 2.0)", "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 1.0))", "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)), ((5.0 5.0, 6.0 5.0, 6.0 6.0, 5.0 5.0)))"]
    assert [wkb_to_wkt(wkt_to_wkb(s)) for s in shapes] == shapes
    df = spark.createDataFrame([(i, float(i) / 2, f"n'{i}", shapes[i % 3]) for i in range(50)] + [(99, None, None, None), (98, 1.0, "", "POLYGON EMPTY")], "id long, v double, name string, geometry string")
    done = write_gpkg(df.repartition(3), str(tmp_path / "g"), "layer", 32604).collect()
    assert sum(r.rows for r in done) == 52
    got = {r.id: r for r in read_gpkg(spark, str(tmp_path / "g")).collect()}
    assert len(got) == 52 and got[7].geometry == shapes[1] and got[7].name == "n'7" and got[7].v == 3.5
    assert got[99].geometry is None and got[99].v is None and got[98].geometry is None


def test_packed_tiffs_are_read(spark, tmp_path):
    """Files put together by hand: LZW, PackBits, and floating-point differences under deflate."""
    rng = np.random.default_rng(5)
    ints, floats = rng.integers(0, 9, (40, 30)).astype("<u2"), rng.normal(0, 5, (40, 30)).astype("<f4")

    def lzw(data):
        out, bits, n, width, table = [], 0, 0, 9, {}

        def put(code):
            nonlocal bits, n
            bits, n = bits << width | code, n + width

        put(256)
        table, word = {bytes([i]): i for i in range(256)}, b""
        for b in data:
            if word + bytes([b]) in table:
                word += bytes([b])
                continue
            put(table[word])
            table[word + bytes([b])] = len(table) + 2
            word = bytes([b])
            if len(table) + 2 >= 1 << width:
                width += 1
            if len(table) + 2 > 4093:
                put(256)
                table, width = {bytes([i]): i for i in range(256)}, 9
        put(table[word])
        put(257)
        pad = -n % 8
        return (bits << pad).to_bytes((n + pad) // 8, "big")

    def packed(data):
        return b"".join(bytes([len(c) - 1]) + c for c in (data[i : i + 100] for i in range(0, len(data), 100)))

    planes = floats.astype(">f4").view(np.uint8).reshape(40, 30, 4).transpose(0, 2, 1).reshape(40, 120)
    third = np.diff(planes, axis=1, prepend=np.zeros((40, 1), np.uint8)).astype(np.uint8)
    run = np.full((40, 30), 7)
    files = {"a": (5, 1, 1, 16, lzw(ints.tobytes()), ints), "b": (32773, 1, 1, 16, packed(ints.tobytes()), ints), "c": (8, 3, 3, 32, zlib.compress(third.tobytes()), floats), "d": (32773, 1, 1, 8, bytes([129, 7]) * 9 + bytes([128, 209, 7]), run)}
    for name, (compression, predictor, form, size, data, _) in files.items():
        tags = [(256, 4, 30), (257, 4, 40), (258, 3, size), (259, 3, compression), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, 40), (279, 4, len(data)), (317, 3, predictor), (339, 3, form)]
        body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
        (tmp_path / f"{name}.tif").write_bytes(b"II" + struct.pack("<HI", 42, 8 + len(data)) + data + body)
    for name, (*_, want) in files.items():
        got = np.zeros((40, 30))
        for r in read_geotiff(spark, str(tmp_path / f"{name}.tif")).collect():
            got[r.row, r.col] = r.v
        assert np.array_equal(got, want.astype(float)), name
    assert {r["name"]: r.grp for r in files_of(spark, str(tmp_path), ".tif", "^([a-c])", 1).collect()} == {"a.tif": "a", "b.tif": "b", "c.tif": "c", "d.tif": ""}
    with pytest.raises(ValueError):
        local_path("hdfs://host/folder")
    assert local_path("file:///x/y") == "/x/y"


def test_gpkg_box_and_overwrite(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"POINT ({i} {2 * i})") for i in range(10)] + [(20, "POLYGON ((3 3, 30 3, 30 30, 3 3))"), (21, None)], "id long, geometry string")
    assert sum(r.rows for r in write_gpkg(df, folder, "things", 32604).collect()) == 12
    assert {r.id for r in read_gpkg(spark, folder, bbox=(2.5, 0, 4, 100)).collect()} == {3, 4, 20}
    with pytest.raises(FileExistsError):
        write_gpkg(df, folder, "things", 32604)
    write_gpkg(df.where("id = 1").coalesce(1), folder, "things", 32604, overwrite=True).collect()
    assert [r.id for r in read_gpkg(spark, folder).collect()] == [1]
