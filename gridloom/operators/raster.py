"""Band arithmetic, stretches, affine mapping and tiles over pixel relations.

A pixel relation has ``raster_id, row, col`` and value columns; all functions keep the other
columns.  Missing measurements are null, never NaN (see ``clean``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.common import checkpoint, estimated_bytes, is_finite

KEYS = ["raster_id"]
#: Side of the tiles by which clips are joined.
CLIP_TILE = 256
#: Accuracy of the sketch that brackets percentiles.
SKETCH = 10_000
#: Size of a table, by the optimiser's estimate, whose values one task can hold.
ONE_TASK_BYTES = 64_000_000


def clean(df: DataFrame, value: str = "v", nodata: Column | None = None) -> DataFrame:
    """Doubles with NaN, infinities and the nodata value turned into null."""
    v = F.col(value).cast("double")
    ok = is_finite(v) if nodata is None else is_finite(v) & (nodata.isNull() | (v != nodata))
    return df.withColumn(value, F.when(ok, v))


def select_bands(df: DataFrame, bands: list[int] | None, n_bands: int) -> DataFrame:
    """Rows of the chosen bands (0-based, all by default); IndexError outside 0..n_bands - 1."""
    if bands is None:
        return df
    for b in bands:
        if not 0 <= b < n_bands:
            raise IndexError(f"band {b} is not in 0..{n_bands - 1}")
    return df.where(F.col("band").isin(bands))


def with_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Adds aggregates of each group; they are combined on the map side and joined back."""
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(agg, keys)


def normalize_band(df: DataFrame, keys: list[str] = KEYS, value: str = "v", out: str = "v") -> DataFrame:
    """(x - min) / (max - min) in each band; null for a constant band."""
    d = with_stats(df, keys, _lo=F.min(value), _hi=F.max(value))
    return d.withColumn(out, F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float], out: str = "_p") -> DataFrame:
    """keys, ``out``: exact percentiles (linear interpolation) of each group at the shares ``ps`` in rising order.

    A mergeable sketch first brackets each wanted rank between two values; then only values inside a
    bracket are counted singly and all between brackets together, both on the map side.  So a group
    of n values needs about n / 2,500 entries for each share, instead of all its values in one
    task.  A table that is estimated to fit a task as a whole goes through the plain aggregate, with
    the same result.  Nulls don't count; groups without a value are absent.
    """
    if estimated_bytes(df) <= ONE_TASK_BYTES:
        found = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, ps))).alias(out))
        return found.where(F.col(out).isNotNull())
    names, margin = keys or ["_all"], 2 / SKETCH
    base = (df if keys else df.withColumn("_all", F.lit(0))).select(*names, F.col(value).cast("double").alias("_v")).where("_v is not null")
    marks = F.array(*[F.lit(m) for p in ps for m in (max(0.0, p - margin), min(1.0, p + margin))])
    rough = base.groupBy(*names).agg(F.percentile_approx("_v", marks, SKETCH).alias("_a"), F.count("_v").alias("_n"))
    v, low, high = F.col("_v"), [F.col("_a")[2 * i] for i in range(len(ps))], [F.col("_a")[2 * i + 1] for i in range(len(ps))]
    inside = reduce(lambda a, b: a | b, [v.between(x, y) for x, y in zip(low, high)])
    zone = sum(((v > y).cast("int") for y in high), F.lit(0))
    entries = base.join(rough, names).groupBy(*names, F.when(inside, v).alias("_w"), zone.alias("_z")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_n").alias("_n"))
    last = F.sum("_c").over(Window.partitionBy(*names).orderBy("_lo")) - 1
    placed = entries.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_c") + 1)

    def at(rank: Column) -> Column:
        # a rank between brackets can only be the first or last of its entry
        hit = (F.col("_first") <= rank) & (rank <= F.col("_last"))
        found = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).when(rank == F.col("_first"), F.col("_lo")).when(rank == F.col("_last"), F.col("_hi"))
        return F.max(F.when(hit, F.coalesce(found, F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))))

    place = [(F.col("_n") - 1) * F.lit(p) for p in ps]
    picked = placed.groupBy(*names).agg(*[at(f(p)).alias(f"_{s}{i}") for i, p in enumerate(place) for s, f in (("l", F.floor), ("h", F.ceil))], F.max("_n").alias("_n"))
    values = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]
    return picked.select(*keys, F.array(*values).alias(out))


def counted_percentiles(df: DataFrame, value: str, count: str, ps: list[float], out: str = "_p") -> DataFrame:
    """``out``: one row, the exact percentiles (linear interpolation) of values that each stand for ``count`` rows.

    Values are sorted by ranges and ranks shifted by the counts of the ranges before; null without a value.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.sum(count).alias("_c")).where("_c > 0")
    placed = checkpoint(counts.repartitionByRange(n, "_v").withColumn("_pid", F.spark_partition_id()))
    sizes = placed.groupBy("_pid").agg(F.sum("_c").alias("_m"))
    every = Window.orderBy("_pid")  # over one row a partition
    offsets = sizes.select("_pid", (F.sum("_m").over(every) - F.col("_m")).alias("_before"), F.sum("_m").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    ranked = placed.join(offsets, "_pid").withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy("_pid").orderBy("_v")))
    place = [(F.col("_n") - 1) * F.lit(p) for p in ps]
    at = lambda rank: F.max(F.when((F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end")), F.col("_v")))
    picked = ranked.agg(*[at(f(p)).alias(f"_{s}{i}") for i, p in enumerate(place) for s, f in (("l", F.floor), ("h", F.ceil))], F.max("_n").alias("_n"))
    return picked.select(F.array(*[F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]).alias(out))


def with_percentiles(df: DataFrame, keys: list[str], value: str, low: float, high: float, accuracy: int | None) -> DataFrame:
    """Adds ``_p``, [low, high] percentiles of each group: exact with interpolation, or by a sketch of the given accuracy; null without a value."""
    ps = [low / 100, high / 100]
    if accuracy is None:
        found = exact_percentiles(df, keys, value, ps)
    else:
        found = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*map(F.lit, ps)), accuracy).alias("_p"))
    return df.join(found, keys, "left")


def rescale_to_8bit(df: DataFrame, keys: list[str] = KEYS, value: str = "v", out: str = "v8", low: float = 2, high: float = 98, accuracy: int | None = None) -> DataFrame:
    """255 (x - p) / (q - p) between two percentiles over all bands of a raster, clipped and truncated; 0 where p = q."""
    d = with_percentiles(df, keys, value, low, high, accuracy)
    p, q = F.col("_p")[0], F.col("_p")[1]
    v = F.when(p == q, 0).otherwise(F.least(F.greatest(255 * (F.col(value) - p) / F.when(p != q, q - p), F.lit(0.0)), F.lit(255.0)).cast("int"))
    return d.withColumn(out, v.cast("int")).drop("_p")


def percentile_normalise(df: DataFrame, keys: list[str] = KEYS, value: str = "v", out: str = "n", accuracy: int | None = None) -> DataFrame:
    """Clip at the 2nd and 98th percentile and scale to 0..1; missing values and flat bands become 0."""
    d = with_percentiles(df, keys, value, 2, 98, accuracy)
    p, q = F.col("_p")[0], F.col("_p")[1]
    clipped = F.least(F.greatest(F.col(value), p), q)
    return d.withColumn(out, F.when(F.col(value).isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(clipped - p, q - p), F.lit(0.0)))).drop("_p")


def ndvi(red: Column, nir: Column) -> Column:
    return F.least(F.greatest((nir - red) / (nir + red + 1e-9), F.lit(-1.0)), F.lit(1.0))


def gray(r: Column, g: Column, b: Column) -> Column:
    """Weighted grey value of three bands."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def to_image(df: DataFrame, stretch: str | None = None, low: float = 2, high: float = 98) -> DataFrame:
    """Three bands (long relation with ``band``) as 8-bit values; stretch None (linear between percentiles), "hist" or "clahe"."""
    if stretch not in (None, "hist", "clahe"):
        raise ValueError(f"unknown stretch {stretch!r}")
    out = rescale_to_8bit(df, low=low, high=high)
    if stretch == "hist":
        wide = out.groupBy("raster_id", "row", "col").pivot("band").agg(F.first("v8"))
        b = sorted((c for c in wide.columns if c not in ("raster_id", "row", "col")), key=int)
        return equalize(wide.withColumn("g", F.round(gray(*[F.col(c) for c in b[:3]])).cast("int")).select("raster_id", "row", "col", "g"), "g")
    if stretch == "clahe":
        from gridloom.operators.neighbours import clahe

        return clahe(out.drop("v").withColumnRenamed("v8", "g"), ["raster_id", "band"], "g")
    return out


def equalize(df: DataFrame, value: str, keys: list[str] = KEYS, out: str = "equalized") -> DataFrame:
    """256-level histogram equalisation: round((cdf - cdf_min) / (n - cdf_min) * 255); a single level stays as it is."""
    h = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    lut = (
        h.withColumn("_cdf", F.sum("_c").over(w.orderBy(value)))
        .withColumn("_n", F.sum("_c").over(w))
        .withColumn("_min", F.min("_cdf").over(w))
        .withColumn(out, F.when(F.col("_n") == F.col("_min"), F.col(value)).otherwise(F.bround((F.col("_cdf") - F.col("_min")) / (F.col("_n") - F.col("_min")) * 255)).cast("int"))
        .select(*keys, value, out)
    )
    return df.join(lut, [*keys, value], "left")


def minmax_8bit(df: DataFrame, keys: list[str], value: str = "v", out: str = "u8", per_band: bool = False) -> DataFrame:
    """(x - min) / (max - min + 1e-8) * 255 truncated, over all bands of an image or each band."""
    d = with_stats(df, [*keys, *(["band"] if per_band else [])], _lo=F.min(value), _hi=F.max(value))
    return d.withColumn(out, ((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8) * 255).cast("int")).drop("_lo", "_hi")


def pixel_to_map(col: Column, row: Column, gt: tuple[float, ...]) -> tuple[Column, Column]:
    """x, y of a pixel position under the affine (a, b, c, d, e, f); add 0.5 for cell centres."""
    a, b, c, d, e, f = map(float, gt)
    return a * col + b * row + c, d * col + e * row + f


def map_to_pixel(x: Column, y: Column, gt: tuple[float, ...]) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a map position; the affine, numbers or columns, must be invertible."""
    a, b, c, d, e, f = (v if isinstance(v, Column) else float(v) for v in gt)
    det = a * e - b * d
    if not isinstance(det, Column) and det == 0:
        raise ValueError("the affine transform cannot be inverted")
    col = (e * (x - c) - b * (y - f)) / det
    row = (a * (y - f) - d * (x - c)) / det
    return F.floor(row).cast("int"), F.floor(col).cast("int")


def raster_bounds(width: Column, height: Column, gt: tuple[float, ...]) -> list[Column]:
    """minx, miny, maxx, maxy of an unrotated raster; the affine may be columns."""
    a, _, c, _, e, f = (v if isinstance(v, Column) else F.lit(float(v)) for v in gt)
    x1, y1 = c + a * width, f + e * height
    x0, y0 = c, f
    return [F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)]


def tile_keys(df: DataFrame, size: int) -> DataFrame:
    """``tile_row``, ``tile_col`` and the checkerboard parity ``white``."""
    d = df.withColumn("tile_row", F.expr(f"int(row div {int(size)})")).withColumn("tile_col", F.expr(f"int(col div {int(size)})"))
    return d.withColumn("white", F.pmod(F.col("tile_row") + F.col("tile_col"), F.lit(2)) != 0)


def crop(df: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """Pixels of the window [row0, row1) x [col0, col1); the ranges reach the scan as filters."""
    return df.where((F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))


def window_of_bounds(minx: float, miny: float, maxx: float, maxy: float, gt: tuple[float, ...]) -> tuple[int, int, int, int]:
    """row0, row1, col0, col1 of the cells of an unrotated raster that a map box touches with more than its border."""
    a, _, c, _, e, f = map(float, gt)
    cols, rows = sorted(((minx - c) / a, (maxx - c) / a)), sorted(((miny - f) / e, (maxy - f) / e))
    return math.floor(rows[0]), math.ceil(rows[1]), math.floor(cols[0]), math.ceil(cols[1])


def tile_grid(rasters: DataFrame, step: float, size: float) -> DataFrame:
    """Boxes x0, y0, x1, y1 of each raster (minx, miny, maxx, maxy), ``tile_no`` from 0 row by row from the lower left, cut off at the maximum."""
    if not step > 0:
        raise ValueError("step must be positive")
    n = lambda lo, hi: F.greatest(F.ceil((F.col(hi) - F.col(lo)) / step), F.lit(0)).cast("int")
    d = rasters.withColumn("_nx", n("minx", "maxx")).withColumn("_ny", n("miny", "maxy")).where("_nx > 0 and _ny > 0")
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)))
    x, y = F.col("minx") + F.col("_i") * F.lit(float(step)), F.col("miny") + F.col("_j") * F.lit(float(step))
    return (
        d.withColumn("x0", x).withColumn("y0", y).withColumn("x1", F.least(x + size, F.col("maxx"))).withColumn("y1", F.least(y + size, F.col("maxy")))
        .withColumn("tile_no", F.col("_j") * F.col("_nx") + F.col("_i")).drop("_nx", "_ny", "_i", "_j")
    )


def segments_wanted(mask: DataFrame, pixel_area: float, crown_radius: float) -> DataFrame:
    """round(mask pixels * pixel area / crown area) of each raster; halves go to the even number."""
    area = math.pi * crown_radius**2
    return mask.groupBy("raster_id").agg(F.count(F.lit(1)).alias("pixels")).withColumn("n_segments", F.bround(F.col("pixels") * F.lit(pixel_area) / F.lit(area)).cast("long"))


def blend(tile: Column, background: Column, inside: Column, alpha: Column | None, darken: float) -> Column:
    """A masked tile over a darkened background, by alpha or hard; darken 0 means not darkened."""
    dark = background if darken == 0 else F.floor(background * darken)
    if alpha is None:
        return F.when(inside, tile).otherwise(dark).cast("int")
    return F.least(F.greatest(alpha * tile + (1 - alpha) * dark, F.lit(0.0)), F.lit(255.0)).cast("int")


def mosaic(df: DataFrame, group: list[str], order: str, value: str = "v") -> DataFrame:
    """One raster of all tiles of a group; where they overlap the later (greater ``order``) wins, nulls never do."""
    return df.where(F.col(value).isNotNull()).groupBy(*group, "row", "col").agg(F.max_by(value, order).alias(value))


def stack_layers(features: DataFrame, px: DataFrame, layers: str = "layers") -> DataFrame:
    """fid, band, row, col, v: for each feature (fid, box row0..col1, JSON map of layers) a stack in map order.

    A key "n,name" is a clip of the raster ``name`` (``px.layer``) to the feature's window, a key
    "n,constant" the constant value of the entry.  Bands follow the order of the map, not the numbers.
    Windows and pixels meet by layer and tile; an empty window gives no rows.
    """
    e = features.select("fid", "row0", "row1", "col0", "col1", F.posexplode(F.from_json(layers, "map<string,string>")).alias("band", "key", "value"))
    e = e.withColumn("layer", F.trim(F.element_at(F.split("key", ",", 2), 2)))
    grid = e.where("layer = 'constant' and row1 > row0 and col1 > col0").withColumn("row", F.explode(F.sequence("row0", F.col("row1") - 1))).withColumn("col", F.explode(F.sequence("col0", F.col("col1") - 1)))
    constant = grid.select("fid", "band", "row", "col", F.col("value").try_cast("double").alias("v"))
    span = lambda low, high: F.explode(F.sequence(F.expr(f"int({low} div {CLIP_TILE})"), F.expr(f"int(({high} - 1) div {CLIP_TILE})")))
    wanted = e.where("layer <> 'constant' and row1 > row0 and col1 > col0").withColumn("_tr", span("row0", "row1")).withColumn("_tc", span("col0", "col1"))
    p = px.select("layer", "row", "col", "v").withColumn("_tr", F.expr(f"int(row div {CLIP_TILE})")).withColumn("_tc", F.expr(f"int(col div {CLIP_TILE})"))
    clip = wanted.join(p, ["layer", "_tr", "_tc"]).where("row >= row0 and row < row1 and col >= col0 and col < col1")
    return clip.select("fid", "band", "row", "col", "v").unionByName(constant)
