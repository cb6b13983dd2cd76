"""Statistics of pixels by segment: spectral, radiometric and co-occurrence texture."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECTRAL = ("mean", "variance", "min", "max", "skewness", "kurtosis")
TEXTURAL = ("contrast", "dissimilarity", "homogeneity", "ASM", "energy", "correlation")
#: Offsets (row, col) of a distance of 2 pixels at 0, 45, 90 and 135 degrees.
OFFSETS = ((0, 2), (1, 1), (2, 0), (1, -1))
#: Side of a tile, and rows and box cells worked off at once in a task.
TILE, ROWS_AT_ONCE, CELLS_AT_ONCE = 256, 200_000, 2_000_000


def feature_columns(bands: list[int], spectral: tuple[str, ...] = SPECTRAL, textural_bands: list[int] | None = None, textural: tuple[str, ...] = ()) -> list[str]:
    """Column names of a feature table: id, spectral of each band, texture of each band."""
    texture = [f"b{b}_{s}" for b in (bands if textural_bands is None else textural_bands) for s in textural]
    return ["segment_id", *[f"b{b}_{s}" for b in bands for s in spectral], *texture]


def spectral_stats(px: DataFrame, keys: list[str] = ["segment_id"], value: str = "v", stats: tuple[str, ...] = SPECTRAL) -> DataFrame:
    """Mean, population variance, minimum, maximum, population skewness and excess kurtosis.

    Nulls are ignored; a group of nulls has null statistics, and a constant group has no
    skewness or kurtosis.
    """
    make = {"mean": F.avg, "variance": F.var_pop, "min": F.min, "max": F.max, "skewness": F.skewness, "kurtosis": F.kurtosis}
    v = F.col(value).cast("double")
    return px.groupBy(*keys).agg(*[make[s](v).alias(s) for s in stats])


def spectral_wide(px: DataFrame, bands: list[int], stats: tuple[str, ...] = SPECTRAL) -> DataFrame:
    """One row a segment with ``b{i}_{stat}`` columns, in one aggregation over a wide relation b0, b1, ..."""
    make = {"mean": F.avg, "variance": F.var_pop, "min": F.min, "max": F.max, "skewness": F.skewness, "kurtosis": F.kurtosis}
    return px.groupBy("segment_id").agg(*[make[s](f"b{b}").alias(f"b{b}_{s}") for b in bands for s in stats])


def radiometric_stats(points: DataFrame, key: str = "segment_id", value: str = "intensity") -> DataFrame:
    """Mean and population variance of point intensities."""
    return points.groupBy(key).agg(F.avg(value).alias("mean_intensity"), F.var_pop(value).alias("variance_intensity"))


def structural_stats(*_args, **_kw):
    raise NotImplementedError("structural statistics of point clouds are not defined")


def _levels(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Values scaled to 0..255 and truncated; 0 where low = high."""
    span = high - low
    return np.where(span == 0, 0, (v - low) / np.where(span == 0, 1, span) * 255).astype(np.int64)


def _count_pairs(g: int, boxes: pd.DataFrame, px: pd.DataFrame, own: np.ndarray, tile: int) -> tuple[np.ndarray, ...]:
    """(box number, angle, lower level, higher level, number) of the pairs that begin in each box's own tile."""
    get = lambda c: boxes[c].to_numpy().astype(np.int64)
    tr, tc, r1, c1 = get("_tr") * tile, get("_tc") * tile, get("_r1"), get("_c1")
    top, left = np.maximum(get("_r0"), tr), np.maximum(get("_c0"), tc)
    rows, cols = np.minimum(r1, tr + tile - 1) - top + 1, np.minimum(c1, tc + tile - 1) - left + 1
    first = np.maximum(get("_c0"), left - 1)  # with the column before, for the last angle
    height, width = np.minimum(r1, top + rows + 1) - top + 1, np.minimum(c1, left + cols + 1) - first + 1
    base = np.r_[0, np.cumsum(height * width)]
    low, high = boxes["_a"].to_numpy(float), boxes["_b"].to_numpy(float)
    box = np.repeat(np.arange(g), height * width)
    q = _levels(np.zeros(g), low, high)[box]
    r, c = px.row.to_numpy().astype(np.int64) - top[own], px.col.to_numpy().astype(np.int64) - first[own]
    inside = (r >= 0) & (r < height[own]) & (c >= 0) & (c < width[own])
    q[(base[own] + r * width[own] + c)[inside]] = _levels(px._v.to_numpy(float), low[own], high[own])[inside]
    at = np.arange(base[-1]) - base[box]
    r, c = at // width[box], at % width[box]
    lead = (left - first)[box]
    begins = (r < rows[box]) & (c >= lead) & (c < lead + cols[box])
    out = []
    for angle, (dr, dc) in enumerate(OFFSETS):
        ok = np.flatnonzero(begins & (r + dr < height[box]) & (c + dc >= 0) & (c + dc < width[box]))
        i, j = q[ok], q[ok + dr * width[box[ok]] + dc]
        out.append(((box[ok] * 4 + angle) * 256 + np.minimum(i, j)) * 256 + np.maximum(i, j))
    code, n = np.unique(np.concatenate(out), return_counts=True)
    return code >> 18, code >> 16 & 3, code >> 8 & 255, code & 255, n


def cooccurrence(px: DataFrame, keys: list[str], value: str = "v", tile: int = TILE) -> DataFrame:
    """keys, angle, i, j, n: pairs of levels i <= j at each angle in the bounding box of each segment.

    Pixels of the box that belong to no row, or are null, take part as 0, and values of a box are
    scaled to 0..255 and truncated; a constant box is 0.  Boxes are parted into tiles, to which
    pixels go once (near a tile's border, up to four times); the pairs of many boxes are counted
    together in arrays, so a task holds a bounded number of cells whatever a segment's size.
    """
    v = F.col(value).cast("double")
    box = px.groupBy(*keys).agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"), F.count(value).alias("_known"), F.min(v).alias("_a"), F.max(v).alias("_b")).where("_known > 0")
    full = (F.col("_r1") - F.col("_r0") + 1).cast("long") * (F.col("_c1") - F.col("_c0") + 1) == F.col("_known")
    box = box.withColumn("_a", F.when(full, F.col("_a")).otherwise(F.least("_a", F.lit(0.0)))).withColumn("_b", F.when(full, F.col("_b")).otherwise(F.greatest("_b", F.lit(0.0)))).drop("_known")
    span = lambda low, high: F.explode(F.sequence(F.expr(f"int({low} div {tile})"), F.expr(f"int({high} div {tile})")))
    tiles = box.withColumn("_tr", span("_r0", "_r1")).withColumn("_tc", span("_c0", "_c1"))
    # a pixel is wanted by its own tile, and by those whose pairs may end on it
    cells = px.where(F.col(value).isNotNull()).select(*keys, "row", "col", v.alias("_v")).withColumn("_tr", span("greatest(row - 2, 0)", "row")).withColumn("_tc", span("greatest(col - 2, 0)", "(col + 1)"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    parts = [*keys, "_tr", "_tc"]
    rows = tiles.select(*parts, none("row", "int"), none("col", "int"), none("_v", "double"), *[F.col(c).cast("int").alias(c) for c in ("_r0", "_r1", "_c0", "_c1")], "_a", "_b").unionByName(
        cells.select(*parts, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "_v"), allowMissingColumns=True
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in px.select(*keys).schema) + ", angle int, i int, j int, n long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def work(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
            group = df.groupby(parts, sort=False, dropna=False).ngroup().to_numpy()
            marks = df["_r0"].notna().to_numpy()
            boxes, place = df[marks], np.full(group.max() + 1, -1)
            place[group[marks]] = np.arange(len(boxes))
            own = place[group]
            cell = ~marks & (own >= 0)
            px, own = df[cell], own[cell]
            area = np.cumsum(((boxes._r1 - boxes._r0 + 1).clip(upper=tile + 2) * (boxes._c1 - boxes._c0 + 1).clip(upper=tile + 3)).to_numpy())
            a = 0
            while a < len(boxes):
                b = max(a + 1, int(np.searchsorted(area, (area[a - 1] if a else 0) + CELLS_AT_ONCE)))
                some = (own >= a) & (own < b)
                box, angle, i, j, n = _count_pairs(b - a, boxes.iloc[a:b], px[some], own[some] - a, tile)
                part = boxes[keys].iloc[a + box].reset_index(drop=True)
                yield part.assign(angle=angle, i=i, j=j, n=n)
                a = b

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS_AT_ONCE:
                df = pd.concat(held, ignore_index=True)
                last = df[parts].iloc[-1]
                same = np.ones(len(df), bool)
                for c in parts:
                    same &= (df[c] == last[c]).to_numpy() | (df[c].isna() & pd.isna(last[c])).to_numpy()
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield from work(df.iloc[:cut].reset_index(drop=True))
                held = [df.iloc[cut:]]
        if held and sum(map(len, held)):
            yield from work(pd.concat(held, ignore_index=True))

    return rows.repartition(*parts).sortWithinPartitions(*parts).mapInPandas(run, schema)


def textural_stats(px: DataFrame, keys: list[str] = ["segment_id"], value: str = "v", tile: int = TILE) -> DataFrame:
    """Six co-occurrence properties, averaged over the angles that have pairs.

    The matrix of an angle is symmetric and normalised: a pair of unequal levels is half a pair each
    way.  A segment without any known value, or too small for a pair at any angle, has no row.  With
    zero spread the correlation is 1.
    """
    # all that follows is by segment: one shuffle of counted pairs, at most 4 x 256 x 257 / 2 a segment and tile
    m = cooccurrence(px, keys, value, tile).repartition(*keys).groupBy(*keys, "angle", "i", "j").agg(F.sum("n").cast("double").alias("n"))
    i, j, n = F.col("i"), F.col("j"), F.col("n")
    d = i - j
    s = m.groupBy(*keys, "angle").agg(
        F.sum(n).alias("_n"), F.sum(n * d * d).alias("_d2"), F.sum(n * F.abs(d)).alias("_d1"), F.sum(n / (1 + d * d)).alias("_h"),
        F.sum(F.when(d == 0, n * n).otherwise(n * n / 2)).alias("_nn"), F.sum(n * (i + j)).alias("_i"), F.sum(n * (i * i + j * j)).alias("_ii"), F.sum(n * i * j).alias("_ij"),
    )
    total, mean = F.col("_n"), F.col("_i") / (2 * F.col("_n"))
    variance = F.col("_ii") / (2 * total) - mean * mean
    one = s.select(
        *keys, (F.col("_d2") / total).alias("contrast"), (F.col("_d1") / total).alias("dissimilarity"), (F.col("_h") / total).alias("homogeneity"), (F.col("_nn") / (total * total)).alias("ASM"),
        F.sqrt(F.col("_nn") / (total * total)).alias("energy"), F.when(variance < 1e-15, 1.0).otherwise((F.col("_ij") / total - mean * mean) / F.when(variance >= 1e-15, variance)).alias("correlation"),
    )
    return one.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in TEXTURAL])


def create_objects(wide: DataFrame, bands: list[int], textural_bands: list[int] | None = None, spectral: bool = True, textural: bool = True) -> DataFrame:
    """The feature table of segments from a wide relation (segment_id, row, col, b0, ...)."""
    parts = [spectral_wide(wide, bands)] if spectral else [wide.select("segment_id").distinct()]
    for b in (bands if textural_bands is None else textural_bands) if textural else []:
        stats = textural_stats(wide, value=f"b{b}")
        parts.append(stats.select("segment_id", *[F.col(s).alias(f"b{b}_{s}") for s in TEXTURAL]))
    return reduce(lambda a, b: a.join(b, "segment_id", "left"), parts)
