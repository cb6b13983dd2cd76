"""Neighbourhood operators over dense pixel relations (raster_id, row, col, value).

Row and column scans use window frames.  True two-dimensional kernels run on tiles: each pixel
is copied to the tiles whose halo contains it, and a tile of bounded size is one NumPy array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.common import checkpoint
from gridloom.operators.raster import percentile_normalise

TILE = 256


def _by_row(keys: list[str]):
    return Window.partitionBy(*keys, "row").orderBy("col")


def _by_col(keys: list[str]):
    return Window.partitionBy(*keys, "col").orderBy("row")


def local_maxima(df: DataFrame, k: int, least: float, value: str = "v", keys: list[str] = ["raster_id"]) -> DataFrame:
    """Pixels that equal the maximum of their (2k + 1)^2 window and reach ``least``; all of a plateau."""
    rows = df.withColumn("_m", F.max(value).over(_by_row(keys).rangeBetween(-k, k)))
    both = rows.withColumn("_m", F.max("_m").over(_by_col(keys).rangeBetween(-k, k)))
    return both.where((F.col(value) == F.col("_m")) & (F.col(value) >= least)).drop("_m")


def sobel(df: DataFrame, value: str = "v", out: str = "gradient", keys: list[str] = ["raster_id"]) -> DataFrame:
    """Length of the Sobel gradient of a dense raster, borders repeated."""
    near = lambda c, w, step: F.coalesce(F.lead(c).over(w) if step > 0 else F.lag(c).over(w), F.col(c))
    r, c = _by_row(keys), _by_col(keys)
    d = df.withColumn("_d", near(value, r, 1) - near(value, r, -1)).withColumn("_s", near(value, r, -1) + 2 * F.col(value) + near(value, r, 1))
    d = d.withColumn("_gx", near("_d", c, -1) + 2 * F.col("_d") + near("_d", c, 1)).withColumn("_gy", near("_s", c, 1) - near("_s", c, -1))
    return d.withColumn(out, F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_d", "_s", "_gx", "_gy")


def label_edges(df: DataFrame, label: str = "label", out: str = "edge", keys: list[str] = ["raster_id"]) -> DataFrame:
    """1 where a label differs from its right or lower neighbour, else 0."""
    differs = lambda w: F.coalesce(F.lead(label).over(w) != F.col(label), F.lit(False))
    return df.withColumn(out, (differs(_by_row(keys)) | differs(_by_col(keys))).cast("int"))


def tile_kernel(df: DataFrame, halo: int, kernel: Callable[[np.ndarray], np.ndarray], mode: str = "symmetric", value: str | list[str] = "v", out: str = "v", keys: list[str] = ["raster_id"], tile: int = TILE) -> DataFrame:
    """keys, row, col, ``out``: ``kernel`` applied to dense windows.

    The kernel gets an (h + 2 halo, w + 2 halo) array of doubles, one for each value column if
    ``value`` is a list, NaN where a pixel is absent or null, and returns (h, w).  Beyond the raster it is padded by ``mode`` (as in ``numpy.pad``;
    "nan" for NaN).  Only pixels present in the input come out; a NaN result is null.
    """
    values = [value] if isinstance(value, str) else value
    size = df.groupBy(*keys).agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    span = lambda c, top: F.sequence(F.expr(f"int(greatest({c} - {halo}, 0) div {tile})"), F.expr(f"int(least({c} + {halo}, {top}) div {tile})"))
    spread = (
        df.select(*keys, "row", "col", *[F.col(v).cast("double").alias(f"_x{i}") for i, v in enumerate(values)]).join(size, keys)
        .withColumn("_tr", F.explode(span("row", "_h"))).withColumn("_tc", F.explode(span("col", "_w")))
    )
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), "row int, col int", f"`{out}` double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        r0, c0 = int(first._tr) * tile, int(first._tc) * tile
        h, w = min(tile, int(first._h) + 1 - r0), min(tile, int(first._w) + 1 - c0)
        top, left = min(halo, r0), min(halo, c0)
        bottom, right = min(halo, int(first._h) + 1 - r0 - h), min(halo, int(first._w) + 1 - c0 - w)
        rows, cols = pdf.row.to_numpy(), pdf.col.to_numpy()
        pad = ((halo - top, halo - bottom), (halo - left, halo - right))
        layers = []
        for i in range(len(values)):
            a = np.full((h + top + bottom, w + left + right), np.nan)
            a[rows - r0 + top, cols - c0 + left] = pdf[f"_x{i}"].to_numpy()
            layers.append(np.pad(a, pad, constant_values=np.nan) if mode == "nan" else np.pad(a, pad, mode=mode))
        res = kernel(layers[0] if isinstance(value, str) else np.stack(layers))
        own = (rows >= r0) & (rows < r0 + h) & (cols >= c0) & (cols < c0 + w)
        rows, cols = rows[own], cols[own]
        part = {k: [first[k]] * len(rows) for k in keys}
        return pd.DataFrame({**part, "row": rows, "col": cols, out: res[rows - r0, cols - c0]})

    result = spread.groupBy(*keys, "_tr", "_tc").applyInPandas(run, schema)
    return result.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def _separable(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    k = len(weights)
    a = sum(w * a[i : a.shape[0] - k + 1 + i] for i, w in enumerate(weights))
    return sum(w * a[:, i : a.shape[1] - k + 1 + i] for i, w in enumerate(weights))


def gaussian_weights(sigma: float, radius: int) -> np.ndarray:
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def gaussian(df: DataFrame, sigma: float, truncate: float = 4.0, **kw) -> DataFrame:
    """Gaussian smoothing, cut at ``truncate`` sigma, borders mirrored; missing pixels spread."""
    radius = int(truncate * sigma + 0.5)
    w = gaussian_weights(sigma, radius)
    return tile_kernel(df, radius, lambda a: _separable(a, w), **kw)


def blur(df: DataFrame, kernel: int, **kw) -> DataFrame:
    """Blur by an odd kernel size, sigma taken from it; 0 leaves the values alone."""
    if kernel == 0:
        return df
    if kernel < 0 or kernel % 2 == 0:
        raise ValueError("the kernel size must be odd")
    w = gaussian_weights(0.3 * ((kernel - 1) * 0.5 - 1) + 0.8, kernel // 2)
    return tile_kernel(df, kernel // 2, lambda a: _separable(a, w), mode="reflect", **kw)


def laplacian(df: DataFrame, **kw) -> DataFrame:
    """3x3 Laplacian with weights 2 at the corners and -8 in the middle."""
    def kernel(a: np.ndarray) -> np.ndarray:
        return 2 * (a[:-2, :-2] + a[:-2, 2:] + a[2:, :-2] + a[2:, 2:]) - 8 * a[1:-1, 1:-1]

    return tile_kernel(df, 1, kernel, mode="reflect", **kw)


def local_variance(df: DataFrame, win: int, **kw) -> DataFrame:
    """E[x^2] - E[x]^2 over win x win pixels, borders mirrored; an even window reaches further up and left."""
    def kernel(a: np.ndarray) -> np.ndarray:
        a = a[: a.shape[0] - (win % 2 == 0), : a.shape[1] - (win % 2 == 0)]
        w = np.full(win, 1 / win)
        mean = _separable(a, w)
        return _separable(a * a, w) - mean * mean

    return tile_kernel(df, win // 2, kernel, **kw)


def sharpness(gray_px: DataFrame, win: int, value: str = "v") -> DataFrame:
    """Local variance of the Laplacian, stretched between its 2nd and 98th percentile."""
    lap = laplacian(gray_px, value=value, out="lap")
    return percentile_normalise(checkpoint(local_variance(lap, win, value="lap", out="variance")), value="variance", out="sharpness")


DISK_3 = [(r, c) for r in range(-3, 4) for c in range(-3, 4) if r * r + c * c <= 9]


def entropy(df: DataFrame, value: str = "v8", out: str = "entropy", **kw) -> DataFrame:
    """Base-2 entropy of the 8-bit values in a disk of radius 3; only pixels inside the raster count."""
    def kernel(a: np.ndarray) -> np.ndarray:
        h, w = a.shape[0] - 6, a.shape[1] - 6
        near = [a[3 + r : 3 + r + h, 3 + c : 3 + c + w] for r, c in DISK_3]
        n = sum(~np.isnan(x) for x in near)
        total = np.zeros((h, w))
        for x in near:
            same = sum(x == y for y in near)
            total += np.where(np.isnan(x), 0, np.log2(np.maximum(same, 1) / np.maximum(n, 1)))
        return np.where(n > 0, -total / np.maximum(n, 1) + 0.0, np.nan)

    return tile_kernel(df, 3, kernel, mode="nan", value=value, out=out, **kw)


def feather_alpha(mask: DataFrame, radius: int) -> DataFrame:
    """raster_id, row, col, alpha = clip(1 - d / radius, 0, 1) with d the distance to the nearest mask pixel.

    Only pixels with alpha above 0 come out: each mask pixel reaches the offsets within the
    radius, and the nearest is kept by a map-side minimum.  No raster is gathered.
    """
    offsets = [(r, c, float(np.hypot(r, c))) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c < radius * radius]
    near = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(d).alias("d")) for r, c, d in offsets]))
    return (
        mask.select("raster_id", "row", "col", near.alias("_n"))
        .groupBy("raster_id", (F.col("row") + F.col("_n.dr")).alias("row"), (F.col("col") + F.col("_n.dc")).alias("col"))
        .agg(F.min("_n.d").alias("_d"))
        .select("raster_id", "row", "col", F.greatest(1 - F.col("_d") / radius, F.lit(0.0)).alias("alpha"))
    )


def clahe(df: DataFrame, keys: list[str] = ["raster_id"], value: str = "v8", out: str = "clahe", clip: float = 2.0, grid: int = 8) -> DataFrame:
    """Contrast-limited adaptive equalisation of 8-bit values on a grid of regions.

    Histograms of the regions are counted by Spark; their clipped look-up tables (grid^2 x 256
    values a raster) are joined back, and each pixel blends the four nearest bilinearly.
    """
    size = df.groupBy(*keys).agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    d = df.join(size, keys).withColumn("_th", F.ceil(F.col("_h") / grid)).withColumn("_tw", F.ceil(F.col("_w") / grid))
    hist = d.where(F.col(value).isNotNull()).groupBy(*keys, F.expr("int(row div _th)").alias("_gr"), F.expr("int(col div _tw)").alias("_gc"), value).agg(F.count(F.lit(1)).alias("_c"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), "_lut array<double>"])

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros((grid, grid, 256))
        h[pdf._gr, pdf._gc, pdf[value].astype(int)] = pdf._c
        n = h.sum(axis=2, keepdims=True)
        limit = np.maximum(clip * n / 256, 1)
        over = np.maximum(h - limit, 0).sum(axis=2, keepdims=True)
        cdf = np.cumsum(np.minimum(h, limit) + over / 256, axis=2)
        lut = np.where(n > 0, np.round(np.clip(cdf * 255 / np.maximum(n, 1), 0, 255)), np.arange(256))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_lut": [lut.ravel()]})

    luts = hist.groupBy(*keys).applyInPandas(tables, schema)
    d = d.join(luts, keys)

    def axis(p: str, t: str) -> tuple[Column, Column, Column]:
        f = F.col(p) / F.col(t) - 0.5
        lo = F.floor(f)
        inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(grid - 1)).cast("int")
        return inside(lo), inside(lo + 1), f - lo

    r0, r1, fr = axis("row", "_th")
    c0, c1, fc = axis("col", "_tw")
    at = lambda r, c: F.get("_lut", ((r * grid + c) * 256 + F.col(value)).cast("int"))
    mixed = (1 - fr) * ((1 - fc) * at(r0, c0) + fc * at(r0, c1)) + fr * ((1 - fc) * at(r1, c0) + fc * at(r1, c1))
    return d.withColumn(out, F.bround(mixed).cast("int")).drop("_h", "_w", "_th", "_tw", "_lut")
