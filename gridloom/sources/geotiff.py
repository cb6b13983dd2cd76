"""GeoTIFF as a Spark data source and a distributed writer.

Reading is split by blocks (strips or tiles); only the blocks that meet the wanted bands and
window are read.  Classic TIFF and BigTIFF, either byte order, uncompressed, deflate, LZW or
PackBits, chunky or planar, with or without horizontal or floating-point differencing.  Paths are
those of mounted folders that all executors share.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloom.common import local_path

SCHEMA = "path string, band int, row int, col int, v double"
#: Fixed values of the TIFF format: byte length of each field type, and tag numbers.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113


#: Files up to which headers are read when a scan is planned; of more, each file is a partition and tasks read the headers.
PLANNED_FILES = 64
#: Pixels wanted in a partition.
PARTITION_PIXELS = 4_000_000


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, highest bit first, 256 to clear and 257 to end, widened one code early."""
    out, at, width, held, bits = bytearray(), 0, 9, 0, 0
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    last = b""
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("the LZW data is damaged")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1


def unpack_bits(data: bytes) -> bytes:
    """PackBits: n + 1 literal bytes, or one byte 1 - n times for a negative n."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at] - 256 if data[at] > 127 else data[at]
        at += 1
        if n >= 0:
            out += data[at : at + n + 1]
            at += n + 1
        elif n != -128:
            out += data[at : at + 1] * (1 - n)
            at += 1
    return bytes(out)


#: Fixed values of the format: compression codes and what undoes them.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32773: unpack_bits, 32946: zlib.decompress}


class Header:
    """Layout, georeference and block index of a file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            mark = f.read(16)
            if mark[:2] not in (b"II", b"MM"):
                raise ValueError(f"{path} is no TIFF file")
            self.order = o = "<" if mark[:2] == b"II" else ">"
            big = struct.unpack(o + "H", mark[2:4])[0] == 43
            at = struct.unpack(o + "Q", mark[8:16])[0] if big else struct.unpack(o + "I", mark[4:8])[0]
            f.seek(at)
            n = struct.unpack(o + ("Q" if big else "H"), f.read(8 if big else 2))[0]
            entries = f.read(n * (20 if big else 12))
            tags: dict[int, tuple] = {}
            for i in range(n):
                e = entries[i * (20 if big else 12) :][: 20 if big else 12]
                tag, kind = struct.unpack(o + "HH", e[:4])
                count = struct.unpack(o + ("Q" if big else "I"), e[4:12] if big else e[4:8])[0]
                size, inline = count * TYPE_SIZE.get(kind, 1), e[12:] if big else e[8:]
                if size > len(inline):
                    f.seek(struct.unpack(o + ("Q" if big else "I"), inline)[0])
                    inline = f.read(size)
                if kind == 2:
                    tags[tag] = (inline[:size].rstrip(b"\0").decode("ascii", "replace"),)
                elif kind in TYPE_CODE:
                    tags[tag] = struct.unpack(f"{o}{count}{TYPE_CODE[kind]}", inline[:size])
        one = lambda t, d: tags.get(t, (d,))[0]
        self.width, self.height, self.bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.compression, self.planar, self.predictor = one(COMPRESSION, 1), one(PLANAR, 1), one(PREDICTOR, 1)
        if self.compression not in UNPACK or self.predictor not in (1, 2, 3):
            raise ValueError(f"{path}: compression {self.compression} with predictor {self.predictor} is not supported")
        self.dtype = np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(one(BITS, 8) // 8))
        self.tiled = TILE_OFFSETS in tags
        self.block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if self.tiled else (min(one(ROWS_PER_STRIP, self.height), self.height), self.width)
        self.offsets, self.counts = tags[TILE_OFFSETS if self.tiled else STRIP_OFFSETS], tags[TILE_COUNTS if self.tiled else STRIP_COUNTS]
        nodata = one(NODATA, "").strip()
        self.nodata = float(nodata) if nodata else None
        if TRANSFORMATION in tags:
            m = tags[TRANSFORMATION]
            self.gt = (m[0], m[1], m[3], m[4], m[5], m[7])
        elif PIXEL_SCALE in tags and TIEPOINT in tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = tags[PIXEL_SCALE], tags[TIEPOINT]
            self.gt = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
        else:
            self.gt = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
        keys = tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
        code = found.get(3072, found.get(2048))
        self.crs = f"EPSG:{code}" if code else None

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.height // self.block[0]), -(-self.width // self.block[1])

    def read_block(self, f, plane: int, r: int, c: int) -> np.ndarray:
        """(bands in the block, h, w) of one block; ``plane`` is the band of a planar file, else 0."""
        rows, cols = self.grid
        k = plane * rows * cols + r * cols + c
        f.seek(self.offsets[k])
        raw = f.read(self.counts[k])
        raw = UNPACK[self.compression](raw)
        samples = self.bands if self.planar == 1 else 1
        h = self.block[0] if self.tiled else min(self.block[0], self.height - r * self.block[0])
        w, size = self.block[1], self.dtype.itemsize
        if self.predictor == 3:  # differences of bytes, a row's bytes sorted by significance, highest first
            b = np.cumsum(np.frombuffer(raw, np.uint8, h * w * samples * size).reshape(h, -1, samples), axis=1, dtype=np.uint8)
            b = np.ascontiguousarray(b.reshape(h, size, w * samples).transpose(0, 2, 1))
            a = b.view(self.dtype.newbyteorder(">")).reshape(h, w, samples)
        else:
            a = np.frombuffer(raw, self.dtype, h * w * samples).reshape(h, w, samples)
        if self.predictor == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        a = a[: self.height - r * self.block[0], : self.width - c * self.block[1]]
        return np.moveaxis(a, -1, 0)


class _Blocks(InputPartition):
    """Block rows [first, last) of a plane, or with plane None a whole file."""

    def __init__(self, path: str, plane: int | None = None, first: int = 0, last: int = 0) -> None:
        self.path, self.plane, self.first, self.last = path, plane, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        path = local_path(options["path"])
        self.paths = sorted(glob.glob(os.path.join(path, "**", "*.tif*"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]
        self.bands = {int(b) for b in options["bands"].split(",")} if options.get("bands") else None
        window = [int(x) for x in options["window"].split(",")] if options.get("window") else [0, 1 << 31, 0, 1 << 31]
        self.low, self.high = {"row": window[0], "col": window[2]}, {"row": window[1] - 1, "col": window[3] - 1}

    def pushFilters(self, filters):
        for f in filters:
            name, value = (f.attribute[0], f.value) if hasattr(f, "attribute") and hasattr(f, "value") else (None, None)
            if name in self.low and isinstance(value, int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low[name] = max(self.low[name], value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high[name] = min(self.high[name], value - isinstance(f, LessThan))
            elif name == "band" and isinstance(f, EqualTo):
                self.bands = {value} if self.bands is None else self.bands & {value}
            yield f  # Spark checks the rows as well

    def _planes(self, h: Header) -> list[int]:
        return [p for p in range(h.bands if h.planar == 2 else 1) if h.planar != 2 or self.bands is None or p in self.bands]

    def partitions(self):
        if len(self.paths) > PLANNED_FILES:
            return [_Blocks(p) for p in self.paths]
        out = []
        for path in self.paths:
            h = Header(path)
            step = max(1, PARTITION_PIXELS // (h.block[0] * h.width))
            low, high = max(0, self.low["row"] // h.block[0]), min(h.grid[0], self.high["row"] // h.block[0] + 1)
            out += [_Blocks(path, plane, r, min(high, r + step)) for plane in self._planes(h) for r in range(low, high, step)]
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        h = Header(partition.path)
        whole = partition.plane is None
        with open(partition.path, "rb") as f:
            for plane in self._planes(h) if whole else [partition.plane]:
                for r in range(0, h.grid[0]) if whole else range(partition.first, partition.last):
                    if r * h.block[0] <= self.high["row"] and (r + 1) * h.block[0] > self.low["row"]:
                        yield from self._blocks(h, f, partition.path, plane, r)

    def _blocks(self, h: Header, f, path: str, plane: int, row: int) -> Iterator[pa.RecordBatch]:
        for c in range(h.grid[1]):
            if c * h.block[1] > self.high["col"] or (c + 1) * h.block[1] <= self.low["col"]:
                continue
            a = h.read_block(f, plane, row, c)
            r0, c0 = row * h.block[0], c * h.block[1]
            for i, layer in enumerate(a):
                band = plane if h.planar == 2 else i
                if self.bands is not None and band not in self.bands:
                    continue
                rows, cols = np.indices(layer.shape, dtype=np.int32)
                rows, cols, v = (rows + r0).ravel(), (cols + c0).ravel(), layer.astype(float).ravel()
                keep = (rows >= self.low["row"]) & (rows <= self.high["row"]) & (cols >= self.low["col"]) & (cols <= self.high["col"])
                missing = ~np.isfinite(v) if h.nodata is None else ~np.isfinite(v) | (v == h.nodata)
                yield pa.record_batch([pa.array([path] * int(keep.sum())), pa.array(np.full(keep.sum(), band, np.int32)), pa.array(rows[keep].astype(np.int32)), pa.array(cols[keep].astype(np.int32)), pa.array(v[keep], mask=missing[keep])], names=["path", "band", "row", "col", "v"])


class GeoTiffSource(DataSource):
    """Format "gridloom_geotiff": options path (file, folder or pattern), bands ("0,2"), window ("row0,row1,col0,col1").

    Rows are (path, band from 0, row, col, v); nodata, NaN and infinities are null.
    """

    @classmethod
    def name(cls) -> str:
        return "gridloom_geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_geotiff(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels of files; filters on row, col and band reach the source (the setting below is off by default)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)
    r = spark.read.format("gridloom_geotiff").option("path", path)
    if bands is not None:
        r = r.option("bands", ",".join(map(str, bands)))
    if window is not None:
        r = r.option("window", ",".join(map(str, window)))
    return r.load()


def catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, width, height, n_bands, crs, gt, nodata and the bounds minx, miny, maxx, maxy of files; headers are read by the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            headers = [Header(local_path(p)) for p in batch.path]
            yield pd.DataFrame([(p, h.width, h.height, h.bands, h.crs, list(map(float, h.gt)), h.nodata) for p, h in zip(batch.path, headers)], columns=["path", "width", "height", "n_bands", "crs", "gt", "nodata"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // 16), "path")
    out = files.mapInPandas(run, "path string, width int, height int, n_bands int, crs string, gt array<double>, nodata double")
    x1, y1 = F.col("gt")[2] + F.col("gt")[0] * F.col("width"), F.col("gt")[5] + F.col("gt")[4] * F.col("height")
    return out.withColumns({"minx": F.least(F.col("gt")[2], x1), "miny": F.least(F.col("gt")[5], y1), "maxx": F.greatest(F.col("gt")[2], x1), "maxy": F.greatest(F.col("gt")[5], y1)})


def files_of(spark: SparkSession, folder: str, ending: str = ".tif", pattern: str = "", group: int = 0) -> DataFrame:
    """path, name, grp: files below a folder whose name has the ending, with the part of it that a pattern's group matches."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), (F.regexp_extract(name, pattern, group) if pattern else F.lit(None).cast("string")).alias("grp"))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """row, col of the cells of band 0 that are not zero."""
    return read_geotiff(spark, path, [0]).where("v <> 0").select("path", "row", "col")


def write_geotiff(px: DataFrame, folder: str, gt: tuple[float, ...], epsg: int, dtype: str = "float32", nodata: float = -9999.0, compress: bool = True, tile: int = 256) -> DataFrame:
    """Writes raster_id, band, row, col, v as one tiled planar file for each raster; returns raster_id, path.

    Tiles are filled and compressed in parallel; the file of a raster is then put together in
    tile order as a stream, so no task holds a whole raster.  The write happens when the
    result is read.  ``folder`` must be shared by all executors.
    """
    folder = local_path(folder)
    os.makedirs(folder, exist_ok=True)
    kind = np.dtype(dtype).newbyteorder("<")
    size = px.groupBy("raster_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), (F.max("band") + 1).alias("n"))
    keyed = px.join(size, "raster_id").withColumn("tr", F.expr(f"int(row div {tile})")).withColumn("tc", F.expr(f"int(col div {tile})"))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((tile, tile), nodata).astype(kind)
        a[pdf.row % tile, pdf.col % tile] = pdf.v.fillna(nodata)
        raw = a.tobytes()
        first = pdf.iloc[0]
        return pd.DataFrame({"raster_id": [first.raster_id], "h": [first.h], "w": [first.w], "n": [first.n], "band": [first.band], "tr": [first.tr], "tc": [first.tc], "data": [zlib.compress(raw) if compress else raw]})

    tiles = keyed.groupBy("raster_id", "band", "tr", "tc").applyInPandas(encode, "raster_id long, h int, w int, n int, band int, tr int, tc int, data binary")
    ordered = tiles.repartition("raster_id").sortWithinPartitions("raster_id", "band", "tr", "tc")

    def finish(f, info: dict) -> None:
        rows, cols = -(-info["h"] // tile), -(-info["w"] // tile)
        blank = np.full((tile, tile), nodata).astype(kind).tobytes()
        blank = zlib.compress(blank) if compress else blank
        at = f.tell()
        f.write(blank)
        offsets = [info["at"].get((b, r, c), (at, len(blank))) for b in range(info["n"]) for r in range(rows) for c in range(cols)]
        text = f"{nodata:g}\0".encode()
        form = {"u": 1, "i": 2, "f": 3}[kind.kind]
        keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
        tags = [
            (WIDTH, 4, (info["w"],)), (HEIGHT, 4, (info["h"],)), (BITS, 3, (kind.itemsize * 8,) * info["n"]), (COMPRESSION, 3, (8 if compress else 1,)), (PHOTOMETRIC, 3, (1,)),
            (SAMPLES, 3, (info["n"],)), (PLANAR, 3, (2 if info["n"] > 1 else 1,)), (TILE_WIDTH, 3, (tile,)), (TILE_HEIGHT, 3, (tile,)), (TILE_OFFSETS, 16, tuple(o for o, _ in offsets)), (TILE_COUNTS, 16, tuple(n for _, n in offsets)),
            (FORMAT, 3, (form,) * info["n"]), (TRANSFORMATION, 12, (gt[0], gt[1], 0.0, gt[2], gt[3], gt[4], 0.0, gt[5], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)), (GEO_KEYS, 3, keys), (NODATA, 2, text),
        ]
        entries = []
        for tag, code, values in tags:
            raw = values if code == 2 else struct.pack(f"<{len(values)}{TYPE_CODE[code]}", *values)
            if len(raw) > 8:
                where = f.tell()
                f.write(raw)
                raw = struct.pack("<Q", where)
            entries.append(struct.pack("<HHQ", tag, code, len(values)) + raw.ljust(8, b"\0"))
        start = f.tell()
        f.write(struct.pack("<Q", len(entries)) + b"".join(entries) + struct.pack("<Q", 0))
        f.seek(8)
        f.write(struct.pack("<Q", start))
        f.close()
        os.replace(f.name, info["path"])

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        info, f, done = None, None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if info is None or info["id"] != r.raster_id:
                    if info is not None:
                        finish(f, info)
                    path = os.path.join(folder, f"{r.raster_id}.tif")
                    info = {"id": r.raster_id, "h": r.h, "w": r.w, "n": r.n, "at": {}, "path": path}
                    f = open(f"{path}.{os.getpid()}.tmp", "wb")  # noqa: SIM115
                    f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 0))
                    done.append((r.raster_id, path))
                info["at"][(r.band, r.tr, r.tc)] = (f.tell(), len(r.data))
                f.write(r.data)
        if info is not None:
            finish(f, info)
        yield pd.DataFrame(done, columns=["raster_id", "path"])

    return ordered.mapInPandas(assemble, "raster_id long, path string")
