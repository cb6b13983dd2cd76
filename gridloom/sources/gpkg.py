"""GeoPackage feature tables as a Spark data source, and a writer of one file for each partition."""

from __future__ import annotations

import glob
import os
import re
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.common import local_path
from gridloom.functions.wkt import _NUMBER

ROWS_PER_PARTITION = 100_000
SQL_TYPE = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "boolean": "INTEGER"}
SPARK_TYPE = {"INTEGER": "bigint", "INT": "bigint", "MEDIUMINT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint", "BOOLEAN": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}


def wkb_to_wkt(b: bytes) -> str:
    """Point, Polygon, MultiPolygon and MultiPoint; z and m are dropped."""

    def read(at: int) -> tuple[str, str, int]:
        o = "<" if b[at] == 1 else ">"
        code = struct.unpack_from(o + "I", b, at + 1)[0]
        at += 5
        if code & 0x20000000:
            at += 4
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + {1: 1, 2: 1, 3: 2}.get((code & 0xFFFF) // 1000, 0)
        kind = (code & 0xFFFF) % 1000

        def points(at: int, n: int) -> tuple[str, int]:
            vals = struct.unpack_from(f"{o}{n * dims}d", b, at)
            return ", ".join(f"{vals[i]!r} {vals[i + 1]!r}" for i in range(0, n * dims, dims)), at + 8 * n * dims

        if kind == 1:
            text, at = points(at, 1)
            return "POINT", f"({text})", at
        n = struct.unpack_from(o + "I", b, at)[0]
        at += 4
        parts = []
        for _ in range(n):
            if kind == 3:
                m = struct.unpack_from(o + "I", b, at)[0]
                text, at = points(at + 4, m)
                parts.append(f"({text})")
            elif kind in (4, 6):
                _, text, at = read(at)
                parts.append(text)
            else:
                raise ValueError(f"geometry type {kind} is not supported")
        return {3: "POLYGON", 4: "MULTIPOINT", 6: "MULTIPOLYGON"}[kind], f"({', '.join(parts)})", at

    kind, text, _ = read(0)
    return f"{kind} {text}" if text != "()" else f"{kind} EMPTY"


def wkt_to_wkb(text: str) -> bytes:
    """Point, Polygon and MultiPolygon of two dimensions."""
    head, _, body = text.partition("(")
    kind = head.upper().rpartition(";")[2].split()[0]
    pairs = lambda s: [tuple(float(m) for m in re.findall(_NUMBER, p)[:2]) for p in s.split(",")]
    if kind == "POINT":
        return struct.pack("<BI2d", 1, 1, *pairs(body)[0])

    def polygon(rings: list[str]) -> bytes:
        out = struct.pack("<BII", 1, 3, len(rings))
        for ring in rings:
            ps = pairs(ring)
            out += struct.pack("<I", len(ps)) + b"".join(struct.pack("<2d", *p) for p in ps)
        return out

    if kind == "POLYGON":
        return polygon(re.findall(r"\(([^()]+)\)", "(" + body))
    if kind == "MULTIPOLYGON":
        polys = re.findall(r"\(\s*((?:\([^()]+\)\s*,?\s*)+)\)", body)
        return struct.pack("<BII", 1, 6, len(polys)) + b"".join(polygon(re.findall(r"\(([^()]+)\)", p)) for p in polys)
    raise ValueError(f"{kind} is not supported")


def _strip_header(blob: bytes | None, box: tuple[float, ...] | None = None) -> bytes | None:
    """The WKB of a geometry; None where there is none, or where its envelope lies off ``box``."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 16:
        return None
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    if box is not None and envelope:
        x0, x1, y0, y1 = struct.unpack_from(("<" if blob[3] & 1 else ">") + "4d", blob, 8)
        if x1 < box[0] or x0 > box[2] or y1 < box[1] or y0 > box[3]:
            return None
    return blob[8 + envelope :]


def _bounds(wkt: str) -> tuple[float, float, float, float]:
    """minx, maxx, miny, maxy of a geometry."""
    points = [p.split()[:2] for p in re.sub(r"[A-Za-z()]", " ", wkt.rpartition(";")[2]).split(",")]
    xs, ys = [float(p[0]) for p in points], [float(p[1]) for p in points]
    return min(xs), max(xs), min(ys), max(ys)


def _layer(con: sqlite3.Connection, wanted: str | None) -> tuple[str, str, list[tuple[str, str]]]:
    name, geometry = con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns" + (" WHERE table_name = ?" if wanted else " ORDER BY table_name LIMIT 1"), (wanted,) if wanted else ()).fetchone()
    columns = [(r[1], r[2].upper().split("(")[0]) for r in con.execute(f'PRAGMA table_info("{name}")')]
    return name, geometry, columns


class _Rows(InputPartition):
    def __init__(self, path: str, low: int, high: int) -> None:
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        path = local_path(options["path"])
        self.paths = sorted(glob.glob(os.path.join(path, "*.gpkg"))) if os.path.isdir(path) else [path]
        self.layer = options.get("layer")
        self.box = tuple(map(float, options["bbox"].split(","))) if options.get("bbox") else None

    def partitions(self):
        out = []
        for p in self.paths:
            with sqlite3.connect(f"file:{p}?mode=ro", uri=True) as con:
                name, _, _ = _layer(con, self.layer)
                low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
            if low is not None:
                out += [_Rows(p, a, min(high, a + ROWS_PER_PARTITION - 1)) for a in range(low, high + 1, ROWS_PER_PARTITION)]
        return out

    def read(self, part) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{part.path}?mode=ro", uri=True) as con:
            name, geometry, columns = _layer(con, self.layer)
            listed = ", ".join(f'"{c}"' for c, _ in columns)
            at = [c for c, _ in columns].index(geometry)
            for row in con.execute(f'SELECT {listed} FROM "{name}" WHERE rowid BETWEEN ? AND ?', (part.low, part.high)):
                wkb = _strip_header(row[at], self.box)
                text = None if wkb is None else wkb_to_wkt(wkb)
                if self.box is not None:
                    if text is None:
                        continue
                    x0, x1, y0, y1 = _bounds(text)
                    if x1 < self.box[0] or x0 > self.box[2] or y1 < self.box[1] or y0 > self.box[3]:
                        continue
                yield (*row[:at], text, *row[at + 1 :])


class GpkgSource(DataSource):
    """Format "gridloom_gpkg": options path (file or folder of files), layer, and bbox "minx,miny,maxx,maxy"; geometries come as WKT.

    With a bbox only features whose bounds touch it are read; stored envelopes are looked at before a
    geometry is decoded.
    """

    @classmethod
    def name(cls) -> str:
        return "gridloom_gpkg"

    def schema(self) -> str:
        path = _Reader(self.options).paths[0]
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            _, geometry, columns = _layer(con, self.options.get("layer"))
        return ", ".join(f"`{c}` {'string' if c == geometry else SPARK_TYPE.get(t, 'string')}" for c, t in columns)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features of a file or folder of files, all or those that touch ``bbox``."""
    spark.dataSource.register(GpkgSource)
    r = spark.read.format("gridloom_gpkg").option("path", path)
    r = r.option("bbox", ",".join(map(repr, map(float, bbox)))) if bbox else r
    return (r.option("layer", layer) if layer else r).load()


def write_gpkg(df: DataFrame, folder: str, layer: str, epsg: int, geometry: str = "geometry", overwrite: bool = False) -> DataFrame:
    """Writes each partition as a GeoPackage of its own in a shared folder; returns path and rows when read.

    A folder that already has files is refused, unless ``overwrite`` takes them away first.
    """
    folder = local_path(folder)
    os.makedirs(folder, exist_ok=True)
    old = glob.glob(os.path.join(folder, "*.gpkg"))
    if old and not overwrite:
        raise FileExistsError(f"{folder} has GeoPackages already")
    for path in old:
        os.remove(path)
    columns = [(f.name, SQL_TYPE.get(f.dataType.simpleString(), "TEXT")) for f in df.schema if f.name != geometry]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        path = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.gpkg")
        temp, n = f"{path}.{os.getpid()}.tmp", 0
        if os.path.exists(temp):
            os.remove(temp)
        con = sqlite3.connect(temp)
        con.executescript(f"""PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT);
INSERT INTO gpkg_spatial_ref_sys VALUES ('EPSG:{epsg}', {epsg}, 'EPSG', {epsg}, 'undefined', NULL);
INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES ('{layer}', 'features', '{layer}', {epsg});
INSERT INTO gpkg_geometry_columns VALUES ('{layer}', '{geometry}', 'GEOMETRY', {epsg}, 0, 0);
CREATE TABLE "{layer}" ({", ".join(f'"{c}" {t}' for c, t in columns)}, "{geometry}" BLOB);""")
        for batch in batches:
            head = struct.pack("<2sBBi", b"GP", 0, 3, epsg)  # with an envelope
            blobs = [None if not t or "EMPTY" in t.upper() else head + struct.pack("<4d", *_bounds(t)) + wkt_to_wkb(t) for t in batch[geometry]]
            plain = batch[[c for c, _ in columns]].astype(object).where(batch[[c for c, _ in columns]].notna(), None).to_numpy().tolist()
            con.executemany(f'INSERT INTO "{layer}" VALUES ({", ".join("?" * (len(columns) + 1))})', [(*r, g) for r, g in zip(plain, blobs)])
            n += len(batch)
        con.commit()
        con.close()
        os.replace(temp, path)
        yield pd.DataFrame({"path": [path], "rows": [n]})

    return df.mapInPandas(run, "path string, rows long")
