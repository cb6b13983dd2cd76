"""One query for each operator of the image-analysis library, with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.common import numbered, table
from gridloom.functions import crs
from gridloom.operators import classify, cost, detect, graph, neighbours, raster, seeds, segment, spatial, zonal
from gridloom.operators.near import outline_measures, outlines, points_in_outlines
from gridloom.plans import fixtures as X
from gridloom.plans.problems import _POINT, points as wkt_points

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


# Zonal statistics and texture



@query(f"""WITH {X.PX}, {X.SEG}, m AS (SELECT segment_id, avg(v) AS mu, var_pop(v) AS vp FROM seg GROUP BY 1)
SELECT segment_id, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(power(v - mu, 3)) / power(any_value(vp), 1.5), 6) + 0.0 AS skewness, round(kurtosis_pop(v), 6) + 0.0 AS kurtosis FROM seg JOIN m USING (segment_id) GROUP BY 1""")
def zonal_spectral(spark: SparkSession, d: str) -> DataFrame:
    return r6(zonal.spectral_stats(X.segments(spark, d)), *zonal.SPECTRAL)


@query(f"""WITH {X.PX}, {X.PX8} SELECT {X.SQL_STRIP} AS segment_id, band, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM p8 GROUP BY 1, 2""")
def zonal_multiband(spark: SparkSession, d: str) -> DataFrame:
    px = X.px8(spark, d).withColumn("segment_id", F.expr(X.STRIP))
    return r6(zonal.spectral_stats(px, ["segment_id", "band"], stats=("mean", "variance")), "mean", "variance")


@query(f"""WITH {X.W8} SELECT {X.SQL_STRIP} AS segment_id, {", ".join(f"round(avg(b{b}), 6) AS b{b}_mean, round(max(b{b}), 6) AS b{b}_max" for b in (0, 3, 7))} FROM w8 GROUP BY 1""")
def zonal_wide(spark: SparkSession, d: str) -> DataFrame:
    out = zonal.spectral_wide(X.wide8(spark, d).withColumn("segment_id", F.expr(X.STRIP)), [0, 3, 7], ("mean", "max"))
    return r6(out, *[c for c in out.columns if c != "segment_id"])


@query("SELECT user_id AS segment_id, round(avg(value), 6) AS mean_intensity, round(var_pop(value), 6) AS variance_intensity FROM events GROUP BY 1")
def radiometric_stats(spark: SparkSession, d: str) -> DataFrame:
    pts = table(spark, d, "events").select(F.col("user_id").alias("segment_id"), F.col("value").cast("double").alias("intensity"))
    return r6(zonal.radiometric_stats(pts), "mean_intensity", "variance_intensity")


_GLCM_OF = """mm AS (SELECT segment_id, min(v) AS a, max(v) AS b FROM seg GROUP BY 1),
c AS (SELECT segment_id, row, col, CASE WHEN a = b THEN 0 ELSE CAST(floor((v - a) / (b - a) * 255) AS INTEGER) END AS q FROM seg JOIN mm USING (segment_id)),
o(angle, dr, dc) AS (VALUES (0, 0, 2), (1, 1, 1), (2, 2, 0), (3, 1, -1)),
h AS (SELECT a.segment_id, o.angle, a.q AS i, b.q AS j FROM c a, o, c b WHERE b.segment_id = a.segment_id AND b.row = a.row + o.dr AND b.col = a.col + o.dc),
n AS (SELECT segment_id, angle, i, j, count(*) AS n FROM (SELECT * FROM h UNION ALL SELECT segment_id, angle, j, i FROM h) GROUP BY ALL),
p AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY segment_id, angle) AS p FROM n),
f AS (SELECT segment_id, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm, sqrt(sum(p * p)) AS energy, sum(p * i) AS mi, sum(p * i * i) AS sq, sum(p * i * j) AS ij FROM p GROUP BY 1, 2)"""
_GLCM = f"WITH {X.PX}, {X.SEG}, {_GLCM_OF}"


@query(_GLCM + """ SELECT segment_id, round(avg(contrast), 4) AS contrast, round(avg(dissimilarity), 6) AS dissimilarity, round(avg(homogeneity), 6) AS homogeneity, round(avg(asm), 6) AS "ASM", round(avg(energy), 6) AS energy, round(avg(CASE WHEN sq - mi * mi < 1e-15 THEN 1 ELSE (ij - mi * mi) / (sq - mi * mi) END), 6) AS correlation FROM f GROUP BY 1""")
def glcm_props(spark: SparkSession, d: str) -> DataFrame:
    out = zonal.textural_stats(X.segments(spark, d))
    return r6(out, *[c for c in zonal.TEXTURAL if c != "contrast"]).withColumn("contrast", F.round("contrast", 4))


def _sql_moments(b: str) -> str:
    return f"avg({b}) AS {b}_mean, var_pop({b}) AS {b}_variance, min({b}) AS {b}_min, max({b}) AS {b}_max, avg(power({b} - m_{b}, 3)) / power(var_pop({b}), 1.5) AS {b}_skewness, kurtosis_pop({b}) AS {b}_kurtosis"


_TEXTURE = "avg(contrast) AS b0_contrast, avg(dissimilarity) AS b0_dissimilarity, avg(homogeneity) AS b0_homogeneity, avg(asm) AS b0_ASM, avg(energy) AS b0_energy, avg(CASE WHEN sq - mi * mi < 1e-15 THEN 1 ELSE (ij - mi * mi) / (sq - mi * mi) END) AS b0_correlation"
_FEATURES = zonal.feature_columns([0, 1], textural_bands=[0], textural=zonal.TEXTURAL)


@query(f"""WITH {X.W8}, w AS (SELECT *, {X.SQL_STRIP} AS segment_id, avg(b0) OVER (PARTITION BY {X.SQL_STRIP}) AS m_b0, avg(b1) OVER (PARTITION BY {X.SQL_STRIP}) AS m_b1 FROM w8), seg AS (SELECT segment_id, row, col, b0 AS v FROM w), {_GLCM_OF},
a AS (SELECT segment_id, {_sql_moments("b0")}, {_sql_moments("b1")} FROM w GROUP BY 1), t AS (SELECT segment_id, {_TEXTURE} FROM f GROUP BY 1)
SELECT segment_id, {", ".join(f'round({c}, 4) + 0.0 AS "{c}"' for c in _FEATURES[1:])} FROM a JOIN t USING (segment_id)""")
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    wide = X.wide8(spark, d).withColumn("segment_id", F.expr(X.STRIP))
    return r6(zonal.create_objects(wide, [0, 1], [0]).select(*_FEATURES), *_FEATURES[1:], places=4)


# Band arithmetic and stretches


@query(f"WITH {X.PX}, m AS (SELECT raster_id, min(v) AS a, max(v) AS b FROM px GROUP BY 1) SELECT raster_id, row, col, round((v - a) / (b - a), 6) AS v FROM px JOIN m USING (raster_id)")
def normalize_band(spark: SparkSession, d: str) -> DataFrame:
    return r6(raster.normalize_band(X.px1(spark, d)), "v").select("raster_id", "row", "col", "v")


_V8 = "pq AS (SELECT raster_id, quantile_cont(v, 0.02) AS p, quantile_cont(v, 0.98) AS q FROM px GROUP BY 1), v8 AS (SELECT raster_id, row, col, CAST(floor(least(greatest(255 * (v - p) / (q - p), 0), 255)) AS INTEGER) AS v8 FROM px JOIN pq USING (raster_id))"


@query(f"WITH {X.PX}, {_V8} SELECT raster_id, row, col, v8 FROM v8")
def stretch_8bit(spark: SparkSession, d: str) -> DataFrame:
    return raster.rescale_to_8bit(X.px1(spark, d)).select("raster_id", "row", "col", "v8")


@query(f"WITH {X.W8} SELECT raster_id, row, col, round(least(greatest((b6 - b4) / (b6 + b4 + 1e-9), -1), 1), 6) + 0.0 AS ndvi FROM w8")
def ndvi_wide(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.wide8(spark, d).select("raster_id", "row", "col", raster.ndvi(F.col("b4"), F.col("b6")).alias("ndvi")), "ndvi")


@query(f"WITH {X.PX}, {X.sql_normalise('n', 'px', 'v', 'n')} SELECT raster_id, row, col, round(n, 6) AS n FROM n")
def percentile_normalise(spark: SparkSession, d: str) -> DataFrame:
    return r6(raster.percentile_normalise(X.px1(spark, d)), "n").select("raster_id", "row", "col", "n")


@query(f"WITH {X.W8} SELECT raster_id, row, col, round(0.299 * b1 + 0.587 * b2 + 0.114 * b4, 6) + 0.0 AS gray FROM w8")
def rgb_to_gray(spark: SparkSession, d: str) -> DataFrame:
    return r6(X.wide8(spark, d).select("raster_id", "row", "col", raster.gray(F.col("b1"), F.col("b2"), F.col("b4")).alias("gray")), "gray")


@query(f"WITH {X.PX}, {X.PX8}, m AS (SELECT raster_id, min(v) AS a, max(v) AS b FROM p8 GROUP BY 1) SELECT raster_id, row, col, band, CAST(floor((v - a) / (b - a + 1e-8) * 255) AS INTEGER) AS u8 FROM p8 JOIN m USING (raster_id)")
def detection_minmax(spark: SparkSession, d: str) -> DataFrame:
    return raster.minmax_8bit(X.px8(spark, d), ["raster_id"]).select("raster_id", "row", "col", "band", "u8")


@query(f"""WITH {X.PX}, {_V8}, h AS (SELECT raster_id, v8, count(*) AS c FROM v8 GROUP BY 1, 2), k AS (SELECT raster_id, v8, sum(c) OVER (PARTITION BY raster_id ORDER BY v8) AS cdf FROM h), t AS (SELECT raster_id, min(cdf) AS lo, max(cdf) AS n FROM k GROUP BY 1)
SELECT raster_id, row, col, CAST(CASE WHEN n = lo THEN v8 ELSE round_even((cdf - lo) / (n - lo)::DOUBLE * 255, 0) END AS INTEGER) AS equalized FROM v8 JOIN k USING (raster_id, v8) JOIN t USING (raster_id)""")
def equalize_hist(spark: SparkSession, d: str) -> DataFrame:
    return raster.equalize(raster.rescale_to_8bit(X.px1(spark, d)), "v8").select("raster_id", "row", "col", "equalized")


@query(f"""WITH {X.PX}, {X.PX8}, c3 AS (SELECT * FROM p8 WHERE band IN (1, 2, 4)), pq AS (SELECT raster_id, quantile_cont(v, 0.02) AS p, quantile_cont(v, 0.98) AS q FROM c3 GROUP BY 1),
e AS (SELECT raster_id, row, col, band, floor(least(greatest(255 * (v - p) / (q - p), 0), 255)) AS v8 FROM c3 JOIN pq USING (raster_id)),
g AS (SELECT raster_id, row, col, CAST(round(sum(v8 * CASE band WHEN 1 THEN 0.299::DOUBLE WHEN 2 THEN 0.587::DOUBLE ELSE 0.114::DOUBLE END)) AS INTEGER) AS g FROM e GROUP BY 1, 2, 3),
h AS (SELECT raster_id, g, count(*) AS c FROM g GROUP BY 1, 2), k AS (SELECT raster_id, g, sum(c) OVER (PARTITION BY raster_id ORDER BY g) AS cdf FROM h), t AS (SELECT raster_id, min(cdf) AS lo, max(cdf) AS n FROM k GROUP BY 1)
SELECT raster_id, row, col, g, CAST(CASE WHEN n = lo THEN g ELSE round_even((cdf - lo) / (n - lo)::DOUBLE * 255, 0) END AS INTEGER) AS equalized FROM g JOIN k USING (raster_id, g) JOIN t USING (raster_id)""")
def to_image_hist(spark: SparkSession, d: str) -> DataFrame:
    return raster.to_image(raster.select_bands(X.px8(spark, d), [1, 2, 4], 8), "hist").select("raster_id", "row", "col", "g", "equalized")


_DIMS = "dim AS (SELECT raster_id, max(row) + 1 AS h, max(col) + 1 AS w FROM px GROUP BY 1)"
_CLAHE_AT = "JOIN lu {n} ON {n}.raster_id = k.raster_id AND {n}.gr = {r} AND {n}.gc = {c} AND {n}.v8 = k.v8"


@query(f"""WITH {X.PX}, {_DIMS}, {_V8}, t AS (SELECT raster_id, CAST(ceil(h / 8) AS INTEGER) AS th, CAST(ceil(w / 8) AS INTEGER) AS tw FROM dim),
hi AS (SELECT raster_id, row // th AS gr, col // tw AS gc, v8, count(*) AS c FROM v8 JOIN t USING (raster_id) GROUP BY 1, 2, 3, 4),
al AS (SELECT raster_id, gr, gc, v8, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY raster_id, gr, gc) AS n FROM (SELECT raster_id, gr, gc, v8 FROM t, range(8) a(gr), range(8) b(gc), range(256) q(v8)) LEFT JOIN hi USING (raster_id, gr, gc, v8)),
cl AS (SELECT *, greatest(2.0::DOUBLE * n / 256, 1) AS lim FROM al), ov AS (SELECT *, sum(greatest(c - lim, 0)) OVER (PARTITION BY raster_id, gr, gc) AS over FROM cl),
cd AS (SELECT *, sum(least(c, lim) + over / 256) OVER (PARTITION BY raster_id, gr, gc ORDER BY v8) AS cdf FROM ov),
lu AS MATERIALIZED (SELECT raster_id, gr, gc, v8, CASE WHEN n > 0 THEN round_even(least(greatest(cdf * 255 / n, 0), 255), 0) ELSE v8 END AS z FROM cd),
f AS (SELECT raster_id, row, col, v8, row / th::DOUBLE - 0.5 AS y, col / tw::DOUBLE - 0.5 AS x FROM v8 JOIN t USING (raster_id)),
k AS (SELECT *, y - floor(y) AS fr, x - floor(x) AS fc, least(greatest(floor(y), 0), 7) AS r0, least(greatest(floor(y) + 1, 0), 7) AS r1, least(greatest(floor(x), 0), 7) AS c0, least(greatest(floor(x) + 1, 0), 7) AS c1 FROM f)
SELECT k.raster_id, k.row, k.col, CAST(round_even((1 - fr) * ((1 - fc) * a.z + fc * b.z) + fr * ((1 - fc) * c.z + fc * d.z), 0) AS INTEGER) AS clahe FROM k {_CLAHE_AT.format(n="a", r="r0", c="c0")} {_CLAHE_AT.format(n="b", r="r0", c="c1")} {_CLAHE_AT.format(n="c", r="r1", c="c0")} {_CLAHE_AT.format(n="d", r="r1", c="c1")}""")
def clahe_tile(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.clahe(raster.rescale_to_8bit(X.px1(spark, d))).select("raster_id", "row", "col", "clahe")


# Neighbourhoods

_MAX_W = "(PARTITION BY raster_id, {a} ORDER BY {b} RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(f"""WITH {X.PX}, a AS (SELECT *, max(v) OVER {_MAX_W.format(a="row", b="col")} AS m FROM px), b AS (SELECT *, max(m) OVER {_MAX_W.format(a="col", b="row")} AS m2 FROM a)
SELECT raster_id, row, col, round(v, 6) AS v FROM b WHERE v = m2 AND v >= 0.1""")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return r6(neighbours.local_maxima(X.px1(spark, d), 2, 0.1), "v").select("raster_id", "row", "col", "v")


@query(f"WITH {X.PX}, {X.sql_sobel('g', 'px', 'v')}, {X.sql_normalise('n', 'g', 'gradient', 'n')} SELECT raster_id, row, col, round(n, 6) AS gradient FROM n")
def sobel_gradient(spark: SparkSession, d: str) -> DataFrame:
    out = raster.percentile_normalise(neighbours.sobel(X.px1(spark, d)), value="gradient", out="n")
    return out.select("raster_id", "row", "col", F.round("n", 6).alias("gradient"))


@query(f"WITH {X.PX}, {X.SEG}, {X.sql_edges('e', 'seg', 'segment_id')} SELECT raster_id, row, col, edge FROM e")
def slic_edge(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.label_edges(X.segments(spark, d), "segment_id").select("raster_id", "row", "col", "edge")


_LAP = f"""lo(dr, dc, k) AS (VALUES (-1, -1, 2), (-1, 1, 2), (1, -1, 2), (1, 1, 2), (0, 0, -8)),
lt AS (SELECT raster_id, p.row, p.col, k, {X.sql_reflect("p.row + dr", "h", False)} AS r2, {X.sql_reflect("p.col + dc", "w", False)} AS c2 FROM px p JOIN dim USING (raster_id), lo),
lap AS (SELECT t.raster_id, t.row, t.col, sum(k * p.v) AS lap FROM lt t JOIN px p ON p.raster_id = t.raster_id AND p.row = r2 AND p.col = c2 GROUP BY 1, 2, 3)"""
_VAR = f"""vt AS (SELECT raster_id, p.row, p.col, {X.sql_reflect("p.row + a.i", "h", True)} AS r2, {X.sql_reflect("p.col + b.i", "w", True)} AS c2 FROM lap p JOIN dim USING (raster_id), range(-2, 3) a(i), range(-2, 3) b(i)),
va AS (SELECT t.raster_id, t.row, t.col, avg(l.lap * l.lap) - avg(l.lap) * avg(l.lap) AS variance FROM vt t JOIN lap l ON l.raster_id = t.raster_id AND l.row = r2 AND l.col = c2 GROUP BY 1, 2, 3)"""


@query(f"WITH {X.PX}, {_DIMS}, {_LAP}, {_VAR}, {X.sql_normalise('n', 'va', 'variance', 'sharpness')} SELECT raster_id, row, col, round(sharpness, 6) AS sharpness FROM n")
def laplacian_sharpness(spark: SparkSession, d: str) -> DataFrame:
    return r6(neighbours.sharpness(X.px1(spark, d), 5), "sharpness").select("raster_id", "row", "col", "sharpness")


_GAUSS = f"""kw AS (SELECT i, exp(-0.5 * i * i) / (SELECT sum(exp(-0.5 * j * j)) FROM range(-4, 5) t(j)) AS g FROM range(-4, 5) r(i)),
gt AS (SELECT raster_id, p.row, p.col, a.g * b.g AS wt, {X.sql_reflect("p.row + a.i", "h", True)} AS r2, {X.sql_reflect("p.col + b.i", "w", True)} AS c2 FROM px p JOIN dim USING (raster_id), kw a, kw b),
gs AS (SELECT t.raster_id, t.row, t.col, sum(wt * p.v) AS v FROM gt t JOIN px p ON p.raster_id = t.raster_id AND p.row = r2 AND p.col = c2 GROUP BY 1, 2, 3)"""


@query(f"WITH {X.PX}, {_DIMS}, {_GAUSS} SELECT raster_id, row, col, round(v, 6) + 0.0 AS v FROM gs")
def gaussian_smooth(spark: SparkSession, d: str) -> DataFrame:
    return r6(neighbours.gaussian(X.px1(spark, d), 1.0), "v").select("raster_id", "row", "col", "v")


@query(f"WITH {X.PX}, {_V8}, {X.sql_entropy('e', 'v8', 'v8')} SELECT raster_id, row, col, round(entropy, 6) + 0.0 AS entropy FROM e")
def entropy_texture(spark: SparkSession, d: str) -> DataFrame:
    return r6(neighbours.entropy(raster.rescale_to_8bit(X.px1(spark, d))), "entropy").select("raster_id", "row", "col", "entropy")


@query(f"""WITH {X.PX}, m AS (SELECT raster_id, row, col FROM px WHERE v > 0.25), o AS (SELECT a.i AS dr, b.i AS dc FROM range(-3, 4) a(i), range(-3, 4) b(i) WHERE a.i * a.i + b.i * b.i < 9)
SELECT raster_id, row, col, round(1 - sqrt(min(q)) / 3, 6) AS alpha FROM (SELECT raster_id, CAST(row + dr AS INTEGER) AS row, CAST(col + dc AS INTEGER) AS col, CAST(dr * dr + dc * dc AS DOUBLE) AS q FROM m, o) GROUP BY 1, 2, 3""")
def feather_alpha(spark: SparkSession, d: str) -> DataFrame:
    return r6(neighbours.feather_alpha(X.px1(spark, d).where("v > 0.25"), 3), "alpha")


@query(f"""WITH {X.PX}, {_DIMS}, {_V8}, kw AS (SELECT i, exp(-0.5 * (i / 1.1) * (i / 1.1)) / (SELECT sum(exp(-0.5 * (j / 1.1) * (j / 1.1))) FROM range(-2, 3) t(j)) AS g FROM range(-2, 3) r(i)),
gt AS (SELECT raster_id, p.row, p.col, a.g * b.g AS wt, {X.sql_reflect("p.row + a.i", "h", False)} AS r2, {X.sql_reflect("p.col + b.i", "w", False)} AS c2 FROM px p JOIN dim USING (raster_id), kw a, kw b),
bl AS (SELECT t.raster_id, t.row, t.col, floor(round(sum(wt * p.v8), 6)) AS blurred FROM gt t JOIN v8 p ON p.raster_id = t.raster_id AND p.row = r2 AND p.col = c2 GROUP BY 1, 2, 3),
m AS (SELECT raster_id, row, col FROM px WHERE v > 0.25), o AS (SELECT a.i AS dr, b.i AS dc FROM range(-3, 4) a(i), range(-3, 4) b(i) WHERE a.i * a.i + b.i * b.i < 9),
al AS (SELECT raster_id, row, col, 1 - sqrt(min(q)) / 3 AS alpha FROM (SELECT raster_id, row + dr AS row, col + dc AS col, CAST(dr * dr + dc * dc AS DOUBLE) AS q FROM m, o) GROUP BY 1, 2, 3),
z AS (SELECT raster_id, row, col, v8, floor(blurred * 0.2::DOUBLE) AS dark, coalesce(alpha, 0.0) AS alpha FROM v8 JOIN bl USING (raster_id, row, col) LEFT JOIN al USING (raster_id, row, col))
SELECT raster_id, row, col, CAST(floor(least(greatest(alpha * v8 + (1 - alpha) * dark, 0), 255)) AS INTEGER) AS blended FROM z""")
def feather_blend(spark: SparkSession, d: str) -> DataFrame:
    px = raster.rescale_to_8bit(X.px1(spark, d))
    alpha = neighbours.feather_alpha(px.where("v > 0.25"), 3)
    blurred = neighbours.blur(px, 5, value="v8", out="blurred")
    at = ["raster_id", "row", "col"]
    j = px.join(blurred, at).join(alpha, at, "left")
    return j.select("raster_id", "row", "col", raster.blend(F.col("v8"), F.floor(F.round("blurred", 6)), F.col("v") > 0.25, F.coalesce("alpha", F.lit(0.0)), 0.2).alias("blended"))


_COST_PARTS = f"""{X.W8}, chm AS (SELECT raster_id, row, col, b7 AS v FROM w8), {X.sql_sobel('g', 'chm', 'v')}, {X.sql_normalise('gn', 'g', 'gradient', 'grad')},
gp AS (SELECT raster_id, row, col, b0, 1 - least(greatest((b6 - b4) / (b6 + b4 + 1e-9), -1), 1) AS gg FROM w8), {X.sql_normalise('gq', 'gp', 'gg', 'gap')},
{X.sql_normalise('pn', 'gp', 'b0', 'pan')}, p8 AS (SELECT raster_id, row, col, CAST(floor(pan * 255) AS INTEGER) AS p FROM pn), {X.sql_entropy('en', 'p8', 'p')}, {X.sql_normalise('tx', 'en', 'entropy', 'tex')},
lb AS (SELECT raster_id, row, col, (row // 20) * 2 + col // 4 AS label FROM w8), {X.sql_edges('ed', 'lb', 'label')}, {X.sql_normalise('eb', 'ed', 'edge', 'border')}"""


@query(f"""WITH {_COST_PARTS} SELECT raster_id, row, col, round(least(greatest(0.4 * grad + 0.2 * gap + 0.2 * tex + 0.2 * border, 0), 1), 6) AS cost
FROM gn JOIN gq USING (raster_id, row, col) JOIN tx USING (raster_id, row, col) JOIN eb USING (raster_id, row, col)""")
def cost_surface(spark: SparkSession, d: str) -> DataFrame:
    image = X.wide8(spark, d)
    labels = image.select("raster_id", "row", "col", F.expr("int(row div 20) * 2 + int(col div 4)").alias("label"))
    out = cost.cost_surface(image, image.select("raster_id", "row", "col", F.col("b7").alias("v")), labels, (0.4, 0.2, 0.2, 0.2))
    return r6(out, "cost")


# Tiles, windows, masks, mosaics


@query(f"WITH {X.PX} SELECT raster_id, row // 50 AS tile_row, col // 50 AS tile_col, (row // 50 + col // 50) % 2 <> 0 AS white, count(*) AS n, round(avg(v), 6) AS mean FROM px GROUP BY 1, 2, 3, 4")
def tile_parity(spark: SparkSession, d: str) -> DataFrame:
    return r6(raster.tile_keys(X.px1(spark, d), 50).groupBy("raster_id", "tile_row", "tile_col", "white").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), "mean")


@query("""WITH g AS (SELECT raster_id, minx, miny, maxx, maxy, CAST(ceil((maxx - minx) / 100) AS INTEGER) AS nx, CAST(ceil((maxy - miny) / 100) AS INTEGER) AS ny FROM rasters WHERE maxx > minx AND maxy > miny)
SELECT raster_id, CAST(j.i * nx + i.i AS INTEGER) AS tile_no, minx + i.i * 100.0 AS x0, miny + j.i * 100.0 AS y0, least(minx + i.i * 100.0 + 150, maxx) AS x1, least(miny + j.i * 100.0 + 150, maxy) AS y1 FROM g, LATERAL (SELECT unnest(range(nx)) AS i) i, LATERAL (SELECT unnest(range(ny)) AS i) j""")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return raster.tile_grid(table(spark, d, "rasters"), 100, 150).select("raster_id", "tile_no", "x0", "y0", "x1", "y1")


@query(f"WITH {X.PX} SELECT raster_id, row, count(*) AS n, round(sum(v), 6) AS total FROM px WHERE EXISTS (SELECT 1 FROM px m WHERE m.raster_id = px.raster_id AND m.row = px.row AND m.col = px.col AND m.v > 0) GROUP BY 1, 2")
def mask_semi(spark: SparkSession, d: str) -> DataFrame:
    px = X.px1(spark, d)
    return r6(px.join(px.where("v > 0").select("raster_id", "row", "col"), ["raster_id", "row", "col"], "left_semi").groupBy("raster_id", "row").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "total")


@query(f"WITH {X.PX} SELECT raster_id, row, col, v FROM px WHERE row >= 30 AND row < 90 AND col >= 10 AND col < 40")
def crop_window(spark: SparkSession, d: str) -> DataFrame:
    return raster.crop(X.px1(spark, d), 30, 90, 10, 40).select("raster_id", "row", "col", "v")


@query(f"WITH {X.PX} SELECT raster_id, count(*) AS pixels, CAST(round_even(count(*) * 0.25 / (pi() * 9), 0) AS BIGINT) AS n_segments FROM px WHERE v > 0 GROUP BY 1")
def n_segments_from_mask(spark: SparkSession, d: str) -> DataFrame:
    return raster.segments_wanted(X.px1(spark, d).where("v > 0"), 0.25, 3.0)


@query(f"WITH {X.PX} SELECT raster_id, row % 3 AS grp, row % 40 AS row, col, arg_max(v, row) AS v FROM px GROUP BY 1, 2, 3, 4")
def group_mosaic(spark: SparkSession, d: str) -> DataFrame:
    px = X.px1(spark, d).select("raster_id", (F.col("row") % 3).alias("grp"), F.col("row").alias("ord"), (F.col("row") % 40).alias("row"), "col", "v")
    return raster.mosaic(px, ["raster_id", "grp"], "ord")


@query("SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_layers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("value", F.explode(F.from_json("props", "map<string,int>")).alias("layer", "k")).where("layer = 'k'")
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT feature_class, count(*) AS n FROM training GROUP BY 1")
def hist_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training").groupBy("feature_class").agg(F.count(F.lit(1)).alias("n"))


# Spatial joins

_RINGS = f"""rings AS (SELECT segment_id, row_number() OVER () AS ring_id, ring FROM (SELECT segment_id, unnest(regexp_extract_all(geometry, '[(]([^()]+)[)]', 1)) AS ring FROM (SELECT DISTINCT segment_id, geometry FROM segments WHERE geometry IS NOT NULL))),
vx AS (SELECT segment_id, ring_id, i, CAST(string_split_regex(trim(c), ' +')[1] AS DOUBLE) AS x, CAST(string_split_regex(trim(c), ' +')[2] AS DOUBLE) AS y FROM (SELECT segment_id, ring_id, unnest(range(1, len(cs) + 1)) AS i, unnest(cs) AS c FROM (SELECT segment_id, ring_id, string_split(ring, ',') AS cs FROM rings))),
eg AS (SELECT * FROM (SELECT segment_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM vx WINDOW w AS (PARTITION BY ring_id ORDER BY i)) WHERE x1 IS NOT NULL),
bb AS (SELECT segment_id, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM vx GROUP BY 1)"""

_HITS = "hits AS (SELECT segment_id, class FROM pts JOIN bx ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"


@query(f"WITH {X.PX}, {X.SEG}, {X.BOX}, {X.PTS}, {_HITS} SELECT segment_id, min(class) AS feature_class FROM hits GROUP BY 1 HAVING count(DISTINCT class) = 1")
def label_segments(spark: SparkSession, d: str) -> DataFrame:
    return spatial.label_segments(spatial.points_in_boxes(X.points(spark, d), X.segment_boxes(spark, d), 20))[0]


@query(f"WITH {X.PX}, {X.SEG}, {X.BOX}, {X.PTS}, {_HITS} SELECT segment_id, count(DISTINCT class) AS n_classes FROM hits GROUP BY 1 HAVING count(DISTINCT class) > 1")
def mixed_segments(spark: SparkSession, d: str) -> DataFrame:
    return spatial.label_segments(spatial.points_in_boxes(X.points(spark, d), X.segment_boxes(spark, d), 20))[1]


@query(f"""WITH RINGS, pt AS (SELECT DISTINCT point_id, class, CAST(nullif(regexp_extract(geometry, '{_POINT}', 1), '') AS DOUBLE) AS x, CAST(nullif(regexp_extract(geometry, '{_POINT}', 2), '') AS DOUBLE) AS y FROM labelled_points),
h AS (SELECT pt.point_id, pt.class, eg.segment_id, sum(CASE WHEN (y0 > y) <> (y1 > y) AND ((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) > 0) = (y1 > y0) THEN 1 ELSE 0 END) AS n,
 max(CASE WHEN (x1 - x0) * (y - y0) = (y1 - y0) * (x - x0) AND x BETWEEN least(x0, x1) AND greatest(x0, x1) AND y BETWEEN least(y0, y1) AND greatest(y0, y1) THEN 1 ELSE 0 END) AS e
 FROM pt JOIN bb ON x BETWEEN xa AND xb AND y BETWEEN ya AND yb JOIN eg ON eg.segment_id = bb.segment_id GROUP BY 1, 2, 3)
SELECT segment_id, min(class) AS feature_class FROM h WHERE n % 2 = 1 OR e = 1 GROUP BY 1 HAVING count(DISTINCT class) = 1""".replace("RINGS", _RINGS))
def label_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Labelled points against the segments' outlines: the class of each segment that has one."""
    pts = table(spark, d, "labelled_points")
    inside = points_in_outlines(wkt_points(pts, "point_id"), outlines(table(spark, d, "segments"), "segment_id", "geometry"))
    return spatial.label_segments(inside.join(pts.select("point_id", "class").distinct(), "point_id"))[0]


@query(f"WITH {X.SEEDS} SELECT a.id, b.id AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d FROM s a JOIN s b ON a.id < b.id AND abs(a.x - b.x) <= 1.05 AND abs(a.y - b.y) <= 1.05 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.05")
def range_join_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return r6(spatial.neighbours(X.seeds(spark, d), 1.05).select("id", "other", "d"), "d")


@query(f"WITH {X.PX}, {X.SEEDS} SELECT s.id, px.raster_id, round(px.v, 6) AS sampled FROM s JOIN px ON px.raster_id = {X.SEED_RASTER} AND px.row = CAST(floor((50 - s.y) / 0.5) AS INTEGER) AND px.col = CAST(floor(s.x / 0.5) AS INTEGER)")
def sample_raster_points(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.sample_raster(X.raster_seeds(spark, d), X.px1(spark, d), (0.5, 0, 0, 0, -0.5, 50))
    return r6(out.select("id", "raster_id", "sampled"), "sampled")


@query(f"""WITH {X.DET}, c AS (SELECT box_id, CAST(r AS INTEGER) AS row, unnest(range(CAST(x0 AS BIGINT), CAST(least(x1, 512) AS BIGINT))) AS col FROM (SELECT *, unnest(range(CAST(y0 AS BIGINT), CAST(least(y1, 400) AS BIGINT))) AS r FROM b))
SELECT row, CAST(col AS INTEGER) AS col, max(box_id) AS label FROM c GROUP BY 1, 2""")
def rasterize_boxes(spark: SparkSession, d: str) -> DataFrame:
    return spatial.rasterize_boxes(X.boxes(spark, d), 400, 512, "box_id")


_PAIR = "least(b.x1, z.x1) - greatest(b.x0, z.x0)", "least(b.y1, z.y1) - greatest(b.y0, z.y0)"
_TOUCH = "b.x0 <= z.x1 AND z.x0 <= b.x1 AND b.y0 <= z.y1 AND z.y0 <= b.y1"


@query(f"""WITH {X.DET}, {X.ZONES}, p AS (SELECT box_id, fid, {_PAIR[0]} AS w, {_PAIR[1]} AS h FROM b JOIN z ON {_TOUCH}),
k AS (SELECT box_id, fid, w * h AS area, row_number() OVER (PARTITION BY box_id ORDER BY w * h DESC, CASE WHEN w = 0 OR h = 0 THEN greatest(w, h) ELSE 0 END DESC, fid) AS n FROM p)
SELECT b.box_id, k.fid, coalesce(k.area, 0.0) AS area FROM b LEFT JOIN k ON k.box_id = b.box_id AND k.n = 1""")
def max_overlap_assign(spark: SparkSession, d: str) -> DataFrame:
    items = X.boxes(spark, d).withColumnRenamed("box_id", "item_id")
    return spatial.assign_by_overlap(items, X.zones(spark, d).drop("classes", "acceptable_classes"), 60).select(F.col("item_id").alias("box_id"), "fid", "area")


@query(f"""WITH {X.PX}, {X.SEG}, g AS (SELECT segment_id, count(*) AS n, count(*) FILTER (WHERE row >= 30 AND row < 95 AND col >= 12) AS k FROM seg GROUP BY 1)
SELECT segment_id, CASE WHEN n = k THEN 'within' ELSE 'overlaps' END AS relation FROM g WHERE k > 0""")
def within_overlaps_split(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within_or_overlapping(X.segments(spark, d), F.expr("row >= 30 and row < 95 and col >= 12"))


@query(f"""WITH {X.PX}, {X.SEG}, {X.BOX}, {X.ZONES}, k AS (SELECT segment_id, arg_min(z.classes, fid) AS classes FROM bx b JOIN z ON {_TOUCH} GROUP BY 1)
SELECT bx.segment_id, classes AS acceptable_classes FROM bx LEFT JOIN k USING (segment_id)""")
def class_region_first_match(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.first_region(X.segment_boxes(spark, d), X.zones(spark, d), 60)
    return out.select("segment_id", F.when(F.col("acceptable_classes").isNotNull(), F.array_join("acceptable_classes", ",")).alias("acceptable_classes"))


_CELLS = "SELECT CAST(p_partkey % 20 AS INTEGER) AS row, CAST(p_size % 10 AS INTEGER) AS col, p_partkey AS region_id, concat_ws(',', p_partkey % 5, p_size % 6) AS classes FROM part"


@query(f"WITH c AS (SELECT row, col, string_agg(classes, ',' ORDER BY region_id) AS l FROM ({_CELLS}) GROUP BY 1, 2) SELECT row, col, CASE WHEN contains(l, '6') THEN l ELSE '6,' || l END AS classes FROM c")
def class_list_concat(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select((F.col("p_partkey") % 20).cast("int").alias("row"), (F.col("p_size") % 10).cast("int").alias("col"), F.col("p_partkey").alias("region_id"), F.concat_ws(",", (F.col("p_partkey") % 5).cast("string"), (F.col("p_size") % 6).cast("string")).alias("classes"))
    return spatial.overlay_union(c)


@query(f"""WITH {_RINGS}, g AS (SELECT segment_id, c, unnest(range(CAST(ceil((ya - 1000000) / 6.2 - 0.5) AS BIGINT), CAST(floor((yb - 1000000) / 6.2 - 0.5) AS BIGINT) + 1)) AS r FROM (SELECT *, unnest(range(CAST(ceil((xa - 200000) / 6.2 - 0.5) AS BIGINT), CAST(floor((xb - 200000) / 6.2 - 0.5) AS BIGINT) + 1)) AS c FROM bb)),
p AS (SELECT segment_id, r, c, 200000 + (c + 0.5) * 6.2::DOUBLE AS x, 1000000 + (r + 0.5) * 6.2::DOUBLE AS y FROM g),
h AS (SELECT p.segment_id, r, c, sum(CASE WHEN (y0 > y) <> (y1 > y) AND ((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) > 0) = (y1 > y0) THEN 1 ELSE 0 END) AS n,
 max(CASE WHEN (x1 - x0) * (y - y0) = (y1 - y0) * (x - x0) AND x BETWEEN least(x0, x1) AND greatest(x0, x1) AND y BETWEEN least(y0, y1) AND greatest(y0, y1) THEN 1 ELSE 0 END) AS e FROM p JOIN eg USING (segment_id) GROUP BY 1, 2, 3)
SELECT segment_id, count(*) AS pixels, min(r) AS first_row, max(c) AS last_col FROM h WHERE n % 2 = 1 OR e = 1 GROUP BY 1""")
def polygon_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Segments' outlines burned into a grid."""
    px = spatial.pixels_of_outlines(outlines(table(spark, d, "segments"), "segment_id", "geometry"), 6.2, 200000, 1000000)
    return px.groupBy(F.col("id").alias("segment_id")).agg(F.count(F.lit(1)).alias("pixels"), F.min("row").alias("first_row"), F.max("col").alias("last_col"))


_CRS_B = " - ".join(["xi", *[f"{b!r} * sin({2 * (j + 1)} * xi) * cosh({2 * (j + 1)} * eta)" for j, b in enumerate(crs.BETA)]])
_CRS_E = " - ".join(["eta", *[f"{b!r} * cos({2 * (j + 1)} * xi) * sinh({2 * (j + 1)} * eta)" for j, b in enumerate(crs.BETA)]])
_CRS_L = " + ".join(["chi", *[f"{b!r} * sin({2 * (j + 1)} * chi)" for j, b in enumerate(crs.DELTA)]])


@query(f"""WITH a AS (SELECT raster_id, miny / {crs.SCALE * crs.RADIUS!r} AS xi, (minx - 500000) / {crs.SCALE * crs.RADIUS!r} AS eta FROM rasters), b AS (SELECT raster_id, {_CRS_B} AS x1, {_CRS_E} AS e1 FROM a),
c AS (SELECT *, asin(sin(x1) / cosh(e1)) AS chi FROM b) SELECT raster_id, round(degrees(atan(sinh(e1) / cos(x1))) - 159, 7) AS lon, round(degrees({_CRS_L}), 7) AS lat FROM c""")
def reproject(spark: SparkSession, d: str) -> DataFrame:
    """Lower left corners of the rasters, read as UTM zone 4 north, in degrees."""
    p = crs.to_crs(table(spark, d, "rasters").select("raster_id", F.col("minx").alias("x"), F.col("miny").alias("y")), "EPSG:32604", "EPSG:4326")
    return p.select("raster_id", F.round("x", 7).alias("lon"), F.round("y", 7).alias("lat"))


@query(f"WITH {X.SEEDS}, {{near}} SELECT count(*) AS pairs, round(min(d), 6) AS least, round(quantile_cont(d, 0.5), 6) AS median, round(max(d), 6) AS most FROM nb WHERE d <= 1.05".replace("{near}", "nb AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM s a JOIN s b ON a.id < b.id AND abs(a.x - b.x) <= 1.05 AND abs(a.y - b.y) <= 1.05)"))
def pair_distances(spark: SparkSession, d: str) -> DataFrame:
    p = spatial.distance_counts(X.seeds(spark, d), 1.05)
    middle = raster.counted_percentiles(p, "d", "pairs", [0.5]).select(F.round(F.col("_p")[0], 6).alias("median"))
    return p.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.min("d"), 6).alias("least"), F.round(F.max("d"), 6).alias("most")).join(middle)  # one row each


@query(f"WITH {X.SEEDS} SELECT id AS seed, row_number() OVER (ORDER BY height DESC, id) AS number FROM s")
def sequential_ids(spark: SparkSession, d: str) -> DataFrame:
    """Numbers from 1 in the order of height, without a global sort."""
    s = X.seeds(spark, d).select(F.col("id").alias("seed"), (-F.col("height")).alias("order"))
    return numbered(s, ["order", "seed"], "number", 1).select("seed", "number")


@query("""SELECT regexp_extract(file_name, '^(st[0-9]+)_', 1) AS grp, count(*) AS n, string_agg(file_name, ',' ORDER BY file_name) AS files FROM rasters WHERE ends_with(file_name, '_ms9.tif') GROUP BY 1""")
def file_groups(spark: SparkSession, d: str) -> DataFrame:
    """Files grouped by a pattern in their names."""
    r = table(spark, d, "rasters").where(F.col("file_name").endswith("_ms9.tif")).withColumn("grp", F.regexp_extract("file_name", "^(st[0-9]+)_", 1))
    return r.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("file_name")), ",").alias("files"))


@query("SELECT t.segment_id, c.class_name FROM (SELECT DISTINCT segment_id, feature_class FROM training) t LEFT JOIN (SELECT DISTINCT feature_class, class_name FROM class_ranges) c USING (feature_class)")
def label_names(spark: SparkSession, d: str) -> DataFrame:
    """Class codes as text; the names are the fixed class list, one for each class."""
    names = {r.feature_class: r.class_name for r in table(spark, d, "class_ranges").select("feature_class", "class_name").distinct().collect()}
    return classify.class_names(table(spark, d, "training").select("segment_id", "feature_class").distinct(), names, "feature_class").select("segment_id", "class_name")


@query(f"""WITH {X.PX}, {X.ZONES}, f AS (SELECT fid, CAST(x0 AS BIGINT) % 40 AS c0, CAST(y0 AS BIGINT) % 90 AS r0 FROM z)
SELECT fid, 0 AS band, row, col, v FROM f JOIN px ON raster_id = fid % 5 + 1 AND row >= r0 AND row < r0 + 6 AND col >= c0 AND col < c0 + 5
UNION ALL SELECT fid, 1, CAST(row AS INTEGER), CAST(unnest(range(c0, c0 + 5)) AS INTEGER), 7.5 FROM (SELECT *, unnest(range(r0, r0 + 6)) AS row FROM f)""")
def layer_stack(spark: SparkSession, d: str) -> DataFrame:
    f = X.zones(spark, d).select("fid", (F.col("x0") % 40).cast("int").alias("col0"), (F.col("y0") % 90).cast("int").alias("row0"), F.concat(F.lit('{"2,dem'), (F.col("fid") % 5 + 1).cast("string"), F.lit('":"x","1,constant":"7.5"}')).alias("layers"))
    f = f.withColumn("col1", F.col("col0") + 5).withColumn("row1", F.col("row0") + 6)
    return raster.stack_layers(f, X.px1(spark, d).withColumn("layer", F.concat(F.lit("dem"), F.col("raster_id").cast("string"))))


# Detection data


@query("""WITH g AS (SELECT raster_id, minx, maxy, CAST(ceil((maxx - minx) / 100) AS INTEGER) AS nx, CAST(ceil((maxy - miny) / 100) AS INTEGER) AS ny FROM rasters WHERE maxx > minx AND maxy > miny),
t AS (SELECT raster_id, minx, maxy, CAST(j.i * nx + i.i AS INTEGER) AS tile_no, i.i * 200 AS c, j.i * 200 AS r FROM g, LATERAL (SELECT unnest(range(nx)) AS i) i, LATERAL (SELECT unnest(range(ny)) AS i) j)
SELECT raster_id, tile_no, printf('img_%03d.jpg', tile_no) AS tile_name, round(0.5 * c + minx, 4) AS corner_x, round(-0.5 * r + maxy, 4) AS corner_y, 'EPSG:32604' AS crs FROM t""")
def transforms_json(spark: SparkSession, d: str) -> DataFrame:
    """The affine of every tile of every raster as JSON, and what is read from it again."""
    tiles = raster.tile_grid(table(spark, d, "rasters"), 100, 150).select("raster_id", "tile_no", F.round((F.col("x0") - F.col("minx")) * 2).alias("col0"), F.round((F.col("y0") - F.col("miny")) * 2).alias("row0"), "minx", "maxy")
    j = detect.transforms_json(tiles, (0.5, 0, F.col("minx"), 0, -0.5, F.col("maxy")), "EPSG:32604", ["raster_id"])
    read = F.from_json("json", "transform array<double>, crs string")
    return j.withColumn("_j", read).select("raster_id", "tile_no", "tile_name", F.round(F.col("_j.transform")[2], 4).alias("corner_x"), F.round(F.col("_j.transform")[5], 4).alias("corner_y"), "_j.crs")


@query(f"""WITH {X.PX}, {X.DET}, m AS (SELECT raster_id, row, min(v) AS a, max(v) AS b FROM px GROUP BY 1, 2), u AS (SELECT {X.MAP_ROW} AS image, sum(CAST(floor((v - a) / (b - a + 1e-8) * 255) AS INTEGER)) AS total FROM px JOIN m USING (raster_id, row) GROUP BY 1)
SELECT CAST(image AS BIGINT) AS image_id, CAST(total AS BIGINT) AS total, count(*) AS boxes FROM u JOIN b ON b.image_id = u.image GROUP BY 1, 2""")
def detection_samples(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))
    s = detect.detection_samples(images, X.boxes(spark, d))
    return s.select("image_id", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.size("target").cast("long").alias("boxes"))


@query(f"WITH {X.DET}, c AS (SELECT box_id, least(greatest(x0 - 120, 0), 255) AS x0, least(greatest(y0 - 100, 0), 199) AS y0, least(greatest(x1 - 120, 0), 255) AS x1, least(greatest(y1 - 100, 0), 199) AS y1 FROM b) SELECT * FROM c WHERE x0 < x1 AND y0 < y1")
def box_clamp(spark: SparkSession, d: str) -> DataFrame:
    return detect.clamp_boxes(X.boxes(spark, d).select("box_id", "x0", "y0", "x1", "y1"), F.lit(100.0), F.lit(120.0), F.lit(200.0), F.lit(256.0))


@query(f"""WITH {X.DET}, p AS (SELECT a.box_id, c.box_id AS r_box_id, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (c.x1 - c.x0) * (c.y1 - c.y0) AS t FROM b a JOIN b c ON a.image_id = c.image_id AND a.box_id < c.box_id)
SELECT box_id, r_box_id, round(i / (s + t - i + 1e-6), 6) AS iou FROM p WHERE i > 0""")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return r6(detect.iou_pairs(X.boxes(spark, d), 30).select("box_id", "r_box_id", "iou"), "iou")


@query(f"""WITH RECURSIVE {X.DET}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS n FROM b),
g AS (SELECT image_id, CAST(0 AS BIGINT) AS n, [] :: STRUCT(i BIGINT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE)[] AS kept FROM b GROUP BY 1
 UNION ALL
 SELECT g.image_id, o.n, CASE WHEN len(list_filter(g.kept, lambda k: greatest(0, least(k.c, o.x1) - greatest(k.a, o.x0)) * greatest(0, least(k.d, o.y1) - greatest(k.b, o.y0)) > 0.2
  * ((k.c - k.a) * (k.d - k.b) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(0, least(k.c, o.x1) - greatest(k.a, o.x0)) * greatest(0, least(k.d, o.y1) - greatest(k.b, o.y0)) + 1e-6))) > 0
  THEN g.kept ELSE list_append(g.kept, struct_pack(i := o.box_id, a := o.x0, b := o.y0, c := o.x1, d := o.y1)) END FROM g JOIN o ON o.image_id = g.image_id AND o.n = g.n + 1),
l AS (SELECT arg_max(kept, n) AS kept FROM g GROUP BY image_id)
SELECT b.* FROM b JOIN (SELECT unnest(kept).i AS box_id FROM l) USING (box_id)""")
def greedy_nms(spark: SparkSession, d: str) -> DataFrame:
    return detect.box_nms(X.boxes(spark, d), 30, 0.2)


_TILES = "t AS (SELECT CAST(j * 5 + i AS INTEGER) AS tile_no, i * 100.0::DOUBLE AS x0, j * 100.0::DOUBLE AS y0, i * 100.0::DOUBLE + 150 AS x1, j * 100.0::DOUBLE + 150 AS y1 FROM range(5) a(i), range(4) b(j))"
_INSIDE = "SELECT t.tile_no, b.box_id, CAST(b.x0 - t.x0 AS INTEGER) AS x0, CAST(b.y0 - t.y0 AS INTEGER) AS y0, CAST(b.x1 - t.x0 AS INTEGER) AS x1, CAST(b.y1 - t.y0 AS INTEGER) AS y1 FROM b JOIN t ON b.x0 >= t.x0 AND b.x1 <= t.x1 AND b.y0 >= t.y0 AND b.y1 <= t.y1"


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([(0.0, 0.0, 500.0, 400.0)], "minx double, miny double, maxx double, maxy double")
    tiles = raster.tile_grid(one, 100, 150).select("tile_no", "x0", "y0", (F.col("x0") + 150).alias("x1"), (F.col("y0") + 150).alias("y1"))
    a = detect.tile_annotations(tiles, X.boxes(spark, d), 150)
    local = [(F.col(c) - F.col("r_x0" if c[0] == "x" else "r_y0")).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return a.select(F.col("tile_no").cast("int").alias("tile_no"), "box_id", "label", *local)


@query(f"WITH {X.DET}, {_TILES} {_INSIDE}")
def tile_box_annotations(spark: SparkSession, d: str) -> DataFrame:
    return _annotations(spark, d).drop("label")


@query(f"""WITH {X.DET}, {_TILES}, a AS ({_INSIDE}) SELECT tile_no, printf('img_%03d', tile_no) AS image,
CAST(json_object('file_name', printf('img_%03d.jpg', tile_no), 'boxes', list([x0, y0, x1, y1] ORDER BY box_id), 'labels', list(1 ORDER BY box_id)) AS VARCHAR) AS json FROM a GROUP BY 1""")
def annotations_json(spark: SparkSession, d: str) -> DataFrame:
    return detect.annotations_json(_annotations(spark, d))


@query(f"""WITH {X.DET}, {_TILES}, a AS ({_INSIDE}) SELECT printf('img_%03d', tile_no) AS image, CAST(row_number() OVER (PARTITION BY tile_no ORDER BY box_id) - 1 AS INTEGER) AS box_no, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, 1 AS label FROM a""")
def annotations_read(spark: SparkSession, d: str) -> DataFrame:
    """Annotations written as JSON and read again."""
    j = detect.annotations_json(_annotations(spark, d)).select(F.concat(F.lit('{"'), "image", F.lit('":'), "json", F.lit("}")).alias("j"))
    return detect.explode_annotations(j, "j").drop("file_name")


_TR = "tr AS (SELECT 'tile_' || r_regionkey AS tile_name, 200000.0::DOUBLE + r_regionkey * 1000 AS c, 1000000.0::DOUBLE AS f FROM region)"


@query(f"""WITH {X.DET}, {_TR}, j AS (SELECT * FROM (SELECT *, 'tile_' || (box_id % 7) AS tile_name FROM b) JOIN tr USING (tile_name))
SELECT tile_name, box_id, 0.5 * x0 + c AS minx, -0.5 * y1 + f AS miny, 0.5 * x1 + c AS maxx, -0.5 * y0 + f AS maxy, 'Tree' AS label, round(score, 6) AS score, 'EPSG:32604' AS crs FROM j""")
def affine_boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    t = table(spark, d, "region").select(F.concat(F.lit("tile_"), k.cast("string")).alias("tile_name"), F.array(F.lit(0.5), F.lit(0.0), 200000.0 + k * 1000, F.lit(0.0), F.lit(-0.5), F.lit(1000000.0)).alias("transform"), F.lit("EPSG:32604").alias("crs"))
    p = X.boxes(spark, d).withColumn("tile_name", F.concat(F.lit("tile_"), (F.col("box_id") % 7).cast("string")))
    return r6(detect.georeference(p, t), "score")


@query(f"WITH {X.DET} SELECT box_id, x0, y0, x1, y1, TRUE AS inside FROM b")
def augmented_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes turned and flipped at random, and turned back by the marks of what was done."""
    a = detect.augment(X.boxes(spark, d).withColumn("width", F.lit(600.0)).withColumn("height", F.lit(500.0)), seed=7)
    inside = F.expr("x0 >= 0 and y0 >= 0 and x1 <= width and y1 <= height and x0 < x1 and y0 < y1")
    u0, u1 = F.when(F.col("flipped"), F.col("width") - F.col("x1")).otherwise(F.col("x0")), F.when(F.col("flipped"), F.col("width") - F.col("x0")).otherwise(F.col("x1"))
    turned = lambda yes, no, name: F.when(F.col("rotated"), yes).otherwise(no).alias(name)
    return a.select("box_id", turned(F.col("height") - F.col("y1"), u0, "x0"), turned(u0, F.col("y0"), "y0"), turned(F.col("height") - F.col("y0"), u1, "x1"), turned(u1, F.col("y1"), "y1"), inside.alias("inside"))


@query(f"WITH {X.DET} SELECT image_id, count(*) AS boxes, TRUE AS fits FROM b GROUP BY 1")
def detection_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of at most four images, taken apart again."""
    b = X.boxes(spark, d)
    samples = b.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_id", "x0", "y0", "x1", "y1"))).alias("target"))
    batches = detect.collate(samples, 4)
    one = batches.select((F.size("images") <= 4).alias("fits"), F.explode(F.arrays_zip("images", "targets")).alias("_z"))
    return one.select(F.col("_z.images").alias("image_id"), F.size("_z.targets").cast("long").alias("boxes"), "fits")


@query(f"""WITH {X.PX}, n AS (SELECT {X.MAP_ROW} AS image_id, col // 8 AS y, col % 8 AS x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8) AS z FROM px WINDOW w AS (PARTITION BY raster_id, row))
SELECT image_id, CAST(min(x) AS DOUBLE) AS x0, CAST(min(y) AS DOUBLE) AS y0, CAST(max(x) + 1 AS DOUBLE) AS x1, CAST(max(y) + 1 AS DOUBLE) AS y1, 0.9::DOUBLE AS score, 1 AS label FROM n WHERE z > 0.8 GROUP BY 1""")
def detection_predict_stub(spark: SparkSession, d: str) -> DataFrame:
    """The prediction hook with a stand-in model: one box around the pixels above 0.8."""

    def model(a: np.ndarray):
        rows, cols = np.nonzero(a[0] > 0.8)
        return (np.array([[cols.min(), rows.min(), cols.max() + 1, rows.max() + 1]]), np.array([0.9]), np.array([1])) if len(rows) else (np.zeros((0, 4)), np.zeros(0), np.zeros(0))

    images = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("bands"), F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))
    return detect.predict(images, model)


@query(f"""WITH {X.PX}, {X.PX8}, k AS (SELECT raster_id, (row // 24) * 24 AS row0, row, col, band, v FROM p8 UNION ALL SELECT raster_id, (row // 24 - 1) * 24, row, col, band, v FROM p8 WHERE row >= 24 AND row % 24 < 8)
SELECT raster_id, CAST(row0 AS INTEGER) AS row0, count(*) AS n, round(sum(v * ((row - row0) * 64 + col * 8 + band)), 4) AS weighted FROM k GROUP BY 1, 2""")
def patch_store(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping patches as arrays: size and position-weighted sum of each."""
    p = detect.patch_arrays(X.px8(spark, d), 32, 8)
    total = F.aggregate(F.transform("pixels", lambda v, i: v * i), F.lit(0.0), lambda a, b: a + b)
    return p.select("raster_id", F.col("row0").cast("int").alias("row0"), F.size("pixels").cast("long").alias("n"), F.round(total, 4).alias("weighted"))


# Seeds

_NEAR = "nb AS (SELECT a.id, b.id AS other, a.x, a.y, b.x AS ox, b.y AS oy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM s a JOIN s b ON a.id < b.id AND abs(a.x - b.x) <= 1.05 AND abs(a.y - b.y) <= 1.05)"
_COST = "cp AS (SELECT raster_id, row, col, (v - a) / (b - a) AS cost FROM px JOIN (SELECT raster_id, min(v) AS a, max(v) AS b FROM px GROUP BY 1) USING (raster_id))"
_SEED_NEAR = f"nr AS (SELECT {X.SEED_RASTER} AS raster_id, nb.* FROM nb WHERE id % 5 = other % 5)"


@query(f"""WITH {X.PX}, {X.SEEDS}, {_NEAR}, {_SEED_NEAR}, {_COST},
st AS (SELECT raster_id, id, other, d, CAST(least(greatest(round_even(y + k / 13.0::DOUBLE * (oy - y), 0), 0), {X.HEIGHT - 1}) AS INTEGER) AS row, CAST(least(greatest(round_even(x + k / 13.0::DOUBLE * (ox - x), 0), 0), {X.WIDTH - 1}) AS INTEGER) AS col FROM nr, range(1, 13) r(k) WHERE d <= 1.05 AND d > 0.8)
SELECT raster_id, id, other, round(max(d) * (1 + 0.5 * avg(coalesce(cost, 1))), 6) AS d_eff FROM st LEFT JOIN cp USING (raster_id, row, col) GROUP BY 1, 2, 3 UNION ALL SELECT raster_id, id, other, round(d, 6) FROM nr WHERE d <= 0.8""")
def effective_distance(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of a raster against its own costs."""
    c = raster.normalize_band(X.px1(spark, d), out="cost")
    return r6(seeds.effective_pairs(X.raster_seeds(spark, d), c, X.HEIGHT, X.WIDTH, 1.05, keys=["raster_id"]), "d_eff")


@query(f"""WITH RECURSIVE {X.SEEDS}, {_NEAR}, e AS (SELECT id AS a, other AS b FROM nb WHERE d <= 1.05 UNION ALL SELECT other, id FROM nb WHERE d <= 1.05),
r AS (SELECT id, id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b) SELECT id, min(root) AS component FROM r GROUP BY 1""")
def components(spark: SparkSession, d: str) -> DataFrame:
    s = X.seeds(spark, d)
    return graph.components(s, spatial.links(s, 1.05).select(F.col("id").alias("a"), F.col("other").alias("b")))


_CL = "c AS (SELECT *, CAST(floor(x / 5) AS BIGINT) AS root FROM s)"


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return X.seeds(spark, d).withColumn("root", F.floor(F.col("x") / 5))


@query(f"WITH {X.SEEDS}, {_CL} SELECT id, root FROM c QUALIFY row_number() OVER (PARTITION BY root ORDER BY height DESC, id) <= 3")
def topk_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return seeds.top_k(_clustered(spark, d), 3, ["root"]).select("id", "root")


@query(f"""WITH {X.SEEDS}, {_CL} SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.root = c.root AND o.id <> c.id AND (o.height < c.height OR (o.height = c.height AND o.id > c.id))
 AND sqrt((o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y)) <= greatest(0.5, 0.05 * o.height))""")
def nms_coded(spark: SparkSession, d: str) -> DataFrame:
    return seeds.nms_coded(_clustered(spark, d), 0.5, 0.05, ["root"], 1.2).select("id")


@query(f"""WITH RECURSIVE {X.SEEDS}, {_CL}, o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY height DESC, id) AS n FROM c),
g AS (SELECT root, CAST(0 AS BIGINT) AS n, [] :: STRUCT(i BIGINT, x DOUBLE, y DOUBLE, r DOUBLE)[] AS kept FROM c GROUP BY 1
 UNION ALL
 SELECT g.root, o.n, CASE WHEN len(list_filter(g.kept, lambda k: sqrt((k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y)) <= k.r)) > 0 THEN g.kept
  ELSE list_append(g.kept, struct_pack(i := o.id, x := o.x, y := o.y, r := greatest(0.5, 0.05 * o.height))) END FROM g JOIN o ON o.root = g.root AND o.n = g.n + 1),
l AS (SELECT root, arg_max(kept, n) AS kept FROM g GROUP BY 1) SELECT unnest(kept).i AS id, root FROM l""")
def nms_greedy(spark: SparkSession, d: str) -> DataFrame:
    return seeds.nms_greedy(_clustered(spark, d), 0.5, 0.05, "root", 1.2).select("id", "root")


@query(f"WITH {X.SEEDS}, {_CL}, g AS (SELECT root, max(height) - min(height) AS span, quantile_cont(height, 0.5) AS mid FROM c GROUP BY 1) SELECT id, root, CASE WHEN span > 15 AND height > mid THEN 1 ELSE 0 END AS part FROM c JOIN g USING (root)")
def median_split(spark: SparkSession, d: str) -> DataFrame:
    return seeds.median_split(_clustered(spark, d), 15).select("id", "root", "part")


@query(f"""WITH RECURSIVE {X.SEEDS}, n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS k FROM s),
bl AS MATERIALIZED (SELECT a.k, list(b.k) AS ball, len(list(b.k)) AS m FROM n a JOIN n b ON abs(a.x - b.x) <= 0.6 AND abs(a.y - b.y) <= 0.6 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= least(greatest(a.height * 0.1, 0.3), 0.6) GROUP BY 1),
g AS (SELECT CAST(0 AS BIGINT) AS k, list_transform(range(count(*)), lambda i: CAST(0 AS BIGINT)) AS taken FROM n
 UNION ALL
 SELECT bl.k, CASE WHEN taken[bl.k] = 0 AND m >= 2 THEN list_transform(taken, lambda t, j: CASE WHEN list_contains(ball, j) THEN bl.k ELSE t END) ELSE taken END FROM g JOIN bl ON bl.k = g.k + 1),
l AS (SELECT taken FROM g ORDER BY k DESC LIMIT 1)
SELECT n.id, c.id AS cluster1 FROM n, l LEFT JOIN n c ON c.k = l.taken[n.k]""")
def ball_clusters(spark: SparkSession, d: str) -> DataFrame:
    return seeds.ball_clusters(X.seeds(spark, d), 0.1, 0.3, 0.6).select("id", "cluster1")


@query(f"""WITH {X.PX}, {_DIMS}, {_GAUSS}, a AS (SELECT *, max(v) OVER {_MAX_W.format(a="row", b="col")} AS m FROM gs), b AS (SELECT *, max(m) OVER {_MAX_W.format(a="col", b="row")} AS m2 FROM a)
SELECT raster_id, row, col, CAST(0.5 * (col + 0.5) + 200000 AS DOUBLE) AS x, CAST(-0.5 * (row + 0.5) + 1000000 AS DOUBLE) AS y, round(v, 6) AS height FROM b WHERE v = m2 AND v >= 0.1""")
def seed_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of the smoothed raster at cell centres."""
    out = seeds.peaks(X.px1(spark, d), 0.1, 2, sigma=1.0, gt=(0.5, 0, 200000, 0, -0.5, 1000000))
    return r6(out, "height")


@query(f"""WITH RECURSIVE {X.PX}, {X.SEEDS}, {_NEAR}, {_SEED_NEAR}, {_COST},
st AS (SELECT raster_id, id, other, d, CAST(least(greatest(round_even(y + k / 13.0::DOUBLE * (oy - y), 0), 0), {X.HEIGHT - 1}) AS INTEGER) AS row, CAST(least(greatest(round_even(x + k / 13.0::DOUBLE * (ox - x), 0), 0), {X.WIDTH - 1}) AS INTEGER) AS col FROM nr, range(1, 13) r(k) WHERE d <= 1.05 AND d > 0.8),
ed AS (SELECT id, other, max(d) * (1 + 0.5 * avg(coalesce(cost, 1))) AS de FROM st LEFT JOIN cp USING (raster_id, row, col) GROUP BY 1, 2 UNION ALL SELECT id, other, d FROM nr WHERE d <= 0.8),
e AS (SELECT id AS a, other AS b FROM ed WHERE de <= 1.05 UNION ALL SELECT other, id FROM ed WHERE de <= 1.05),
r AS (SELECT id, id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
c AS (SELECT s.*, m.root FROM s JOIN (SELECT id, min(root) AS root FROM r GROUP BY 1) m USING (id)),
g AS (SELECT root, max(height) - min(height) AS span, quantile_cont(height, 0.5) AS mid FROM c GROUP BY 1),
pt AS (SELECT c.*, CASE WHEN span > 5 AND height > mid THEN 1 ELSE 0 END AS part FROM c JOIN g USING (root)),
tk AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY root, part ORDER BY height DESC, id) <= 3)
SELECT id, {X.SEED_RASTER} AS raster_id, origin, root * 2 + part AS cluster FROM tk c WHERE NOT EXISTS (SELECT 1 FROM tk o WHERE o.root = c.root AND o.part = c.part AND o.id <> c.id AND (o.height < c.height OR (o.height = c.height AND o.id > c.id))
 AND sqrt((o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y)) <= 0.5)""")
def canonical_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of both detectors merged, split, trimmed and suppressed, each raster by its own costs."""
    s, c = X.raster_seeds(spark, d), raster.normalize_band(X.px1(spark, d), out="cost")
    only = lambda o: s.where(F.col("origin") == o).drop("origin")
    out = seeds.canonical_seeds(only("chm"), only("density"), c, X.HEIGHT, X.WIDTH, merge_radius=1.05, dz_merge=5, max_per_cluster=3, nms_base=0.5, keys=["raster_id"])
    return out.select("id", "raster_id", "origin", "cluster")


# Segmentation


def _regions_check(labels: DataFrame, label: str, least: int) -> DataFrame:
    """Of each raster: pixels with a label, distinct pixels, labels that lie in several pieces, and labels of fewer than ``least`` pixels."""
    pieces = segment.connected_regions(labels.withColumn("label", F.col(label)), tile=64).groupBy("raster_id", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("region").alias("p"))
    one = pieces.groupBy("raster_id").agg(F.count_if(F.col("p") > 1).alias("parted"), F.count_if(F.col("n") < least).alias("tiny"))
    pixels = labels.groupBy("raster_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("row", "col").alias("places"))
    return pixels.join(one, "raster_id")


@query(f"WITH {X.W8} SELECT raster_id, count(*) AS pixels, count(*) AS places, CAST(0 AS BIGINT) AS parted, CAST(0 AS BIGINT) AS tiny FROM w8 GROUP BY 1")
def slic_segments(spark: SparkSession, d: str) -> DataFrame:
    """Superpixels cut into connected regions of at least four pixels: what must hold for each raster."""
    labels = segment.slic(X.wide8(spark, d), ["b0", "b1", "b2"], 100, iterations=5)
    return _regions_check(segment.enforce_connectivity(labels, 4), "region", 4)


@query(f"""WITH RECURSIVE {X.PX}, p AS (SELECT raster_id, row, col, v, row * {X.WIDTH} + col AS id FROM px),
n5 AS MATERIALIZED (SELECT raster_id, id, v, row + i.i AS r2, col + j.i AS c2, i.i * i.i + j.i * j.i AS q FROM p, range(-5, 6) i(i), range(-5, 6) j(i)),
de AS MATERIALIZED (SELECT p.*, d.density FROM p JOIN (SELECT a.raster_id, a.id, sum(exp(-(power(a.v - b.v, 2) + q) / 4.5)) AS density FROM n5 a JOIN p b ON b.raster_id = a.raster_id AND b.row = a.r2 AND b.col = a.c2 GROUP BY 1, 2) d USING (raster_id, id)),
n4 AS MATERIALIZED (SELECT raster_id, id, v, density, row + i.i AS r2, col + j.i AS c2, i.i * i.i + j.i * j.i AS q FROM de, range(-4, 5) i(i), range(-4, 5) j(i)),
up AS MATERIALIZED (SELECT a.raster_id, a.id, arg_min(b.id, power(a.v - b.v, 2) + q) AS up FROM n4 a JOIN de b ON b.raster_id = a.raster_id AND b.row = a.r2 AND b.col = a.c2 WHERE b.density > a.density AND power(a.v - b.v, 2) + q <= 16 GROUP BY 1, 2),
w AS (SELECT raster_id, id, id AS at FROM p UNION ALL SELECT w.raster_id, w.id, up.up FROM w JOIN up ON up.raster_id = w.raster_id AND up.id = w.at),
r AS (SELECT w.raster_id, w.id, w.at AS root FROM w LEFT JOIN up ON up.raster_id = w.raster_id AND up.id = w.at WHERE up.up IS NULL)
SELECT p.raster_id, p.row, p.col, min(p.id) OVER (PARTITION BY p.raster_id, r.root) AS label FROM p JOIN r USING (raster_id, id)""")
def quickshift_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.quickshift(X.px1(spark, d), ["v"], kernel_size=1.5, max_dist=4)


@query(f"WITH {X.PX} SELECT raster_id, count(*) AS pixels, count(*) AS places, TRUE AS many FROM px GROUP BY 1")
def tiled_segments(spark: SparkSession, d: str) -> DataFrame:
    """Checkerboard segmentation: every pixel of each raster once, in about as many segments as crowns fit."""
    t = segment.tiled_segments(X.px1(spark, d), ["v"], tile=32, buffer=6, crown_radius=3)
    wanted = X.HEIGHT * X.WIDTH / (3.141592653589793 * 9)
    return t.groupBy("raster_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("row", "col").alias("places"), F.count_distinct("segment_id").between(wanted / 2, wanted * 2).alias("many"))


_REGIONS = f"""{X.PX}, p AS (SELECT raster_id, row, col, row * {X.WIDTH} + col AS id, CAST(floor((v + 1) * 4) AS BIGINT) AS label FROM px),
e AS (SELECT a.raster_id, a.id AS a, b.id AS b FROM p a JOIN p b ON b.raster_id = a.raster_id AND b.label = a.label AND abs(a.row - b.row) + abs(a.col - b.col) = 1 AND b.row BETWEEN a.row - 1 AND a.row + 1),
f AS (SELECT raster_id, id, id AS root FROM p UNION SELECT e.raster_id, e.b, f.root FROM f JOIN e ON e.raster_id = f.raster_id AND e.a = f.id WHERE f.root < e.b),
rg AS (SELECT raster_id, id, min(root) AS region FROM f GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_REGIONS} SELECT raster_id, row, col, label, region FROM p JOIN rg USING (raster_id, id)")
def connected_regions(spark: SparkSession, d: str) -> DataFrame:
    return segment.connected_regions(X.px1(spark, d).withColumn("label", F.floor((F.col("v") + 1) * 4)), tile=64)


@query(f"""WITH RECURSIVE {_REGIONS}, q AS (SELECT raster_id, row, col, region FROM p JOIN rg USING (raster_id, id)),
i AS (SELECT a.raster_id, a.region, count(*) AS inner_sides FROM q a JOIN q b ON b.raster_id = a.raster_id AND b.region = a.region AND abs(a.row - b.row) + abs(a.col - b.col) = 1 AND b.row BETWEEN a.row - 1 AND a.row + 1 GROUP BY 1, 2)
SELECT raster_id, region, any_value(n) * 0.25::DOUBLE AS area, (any_value(n) * 4 - coalesce(any_value(inner_sides), 0)) * 0.5::DOUBLE AS perimeter, any_value(x0) AS minx, any_value(y1) AS maxy
FROM (SELECT raster_id, region, count(*) AS n, 200000 + min(col) * 0.5::DOUBLE AS x0, 1000000 - min(row) * 0.5::DOUBLE AS y1 FROM q GROUP BY 1, 2) LEFT JOIN i USING (raster_id, region) GROUP BY 1, 2""")
def segment_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Outlines of connected regions, holes included: their area, perimeter and corner."""
    regions = segment.connected_regions(X.px1(spark, d).withColumn("label", F.floor((F.col("v") + 1) * 4)), tile=64)
    wkt = segment.outlines_wkt(regions, (0.5, 0, 200000, 0, -0.5, 1000000)).withColumn("id", F.col("raster_id") * 1_000_000 + F.col("region"))
    m = outline_measures(outlines(wkt, "id", "geometry"))
    return m.select(F.expr("id div 1000000").alias("raster_id"), (F.col("id") % 1_000_000).alias("region"), "area", "perimeter", "minx", "maxy")


# Classification

_SCALED = ", ".join(f"round((f{i} - avg(f{i}) OVER ()) / stddev_pop(f{i}) OVER (), 6) + 0.0 AS f{i}" for i in range(64))


@query(f"WITH f AS (SELECT vec_id AS segment_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}' for i in range(64))} FROM embeddings) SELECT segment_id, {_SCALED} FROM f")
def scale_features(spark: SparkSession, d: str) -> DataFrame:
    cols = [f"f{i}" for i in range(64)]
    return r6(classify.scale(X.features(spark, d, 64).drop("feature_class"), cols), *cols)


@query("SELECT count(*) AS n, CAST(ceil(0.4 * count(*)) AS BIGINT) AS test, count(DISTINCT vec_id) AS segments FROM embeddings")
def split_exact(spark: SparkSession, d: str) -> DataFrame:
    """Rows of both parts of a random split, counted."""
    s = classify.split(X.features(spark, d), "segment_id", 0.4)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("test"), F.count_distinct("segment_id").alias("segments"))


@query(f"WITH {X.PAIRS}, c AS (SELECT y AS k FROM q UNION SELECT yhat FROM q) SELECT a.k AS y, b.k AS yhat, (SELECT count(*) FROM q WHERE y = a.k AND yhat = b.k) AS n FROM c a, c b")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return classify.confusion_matrix(X.pairs(spark, d))


@query(f"""WITH {X.PAIRS}, c AS (SELECT y AS k FROM q UNION SELECT yhat FROM q),
p AS (SELECT k, (SELECT count(*) FROM q WHERE y = k AND yhat = k) AS tp, (SELECT count(*) FROM q WHERE yhat = k) AS pr, (SELECT count(*) FROM q WHERE y = k) AS support FROM c),
s AS (SELECT CAST(k AS VARCHAR) AS label, tp, CASE WHEN pr = 0 THEN 0.0 ELSE tp / pr::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support::DOUBLE END AS recall, support FROM p),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s),
l AS (SELECT label, precision, recall, f1, support FROM f UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support)::DOUBLE, CAST(sum(support) AS BIGINT) FROM f
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM l""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return r6(classify.classification_report(X.pairs(spark, d)), "precision", "recall", "f1")


@query("""WITH a AS (SELECT vec_id AS segment_id, list_transform(embedding[1:10], lambda x: abs(CAST(x AS DOUBLE))) AS w, CASE vec_id % 3 WHEN 0 THEN [1, 3, 6] WHEN 1 THEN [2] END AS ok FROM embeddings),
u AS (SELECT segment_id, CAST(unnest(range(10)) AS INTEGER) AS k, unnest(w) / list_sum(w) AS p, ok FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY p DESC, k) AS n FROM u WHERE ok IS NULL OR list_contains(ok, k))
SELECT segment_id, max(k) FILTER (WHERE n = 1) AS predicted_class, round(max(p) FILTER (WHERE n = 1) - max(p) FILTER (WHERE n = 2), 6) AS prediction_margin FROM r GROUP BY 1""")
def constrained_argmax(spark: SparkSession, d: str) -> DataFrame:
    w = F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("segment_id"), w.alias("w"), F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(1), F.lit(3), F.lit(6))).when(F.col("vec_id") % 3 == 1, F.array(F.lit(2))).alias("ok"))
    e = e.withColumn("proba", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, b: a + b)))
    c, m = classify.choose(F.col("proba"), list(range(10)), F.col("ok"))
    return r6(e.select("segment_id", c.alias("predicted_class"), m.alias("prediction_margin")), "prediction_margin")


@query("""WITH f AS (SELECT CAST(label AS INTEGER) AS feature_class, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings), q AS (SELECT feature_class, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM f GROUP BY 1)
SELECT feature_class, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6) AS low, round(max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM f JOIN q USING (feature_class) GROUP BY 1""")
def boxplot_stats(spark: SparkSession, d: str) -> DataFrame:
    return r6(classify.box_plot(X.features(spark, d), "feature_class", "f0"), "q1", "median", "q3", "low", "high")


def _classified(spark: SparkSession, d: str, method: str, **params) -> DataFrame:
    cols = [f"f{i}" for i in range(8)]
    f = classify.split(X.features(spark, d, 8), "segment_id", 0.4)
    train = f.where("not is_test")
    scaled = classify.scale(f, cols, train)
    model = classify.fit(scaled.where("not is_test"), cols, method, **params)
    out = classify.predict(model, scaled)
    c, m = classify.choose(F.col("proba"), classify.class_labels(model), F.lit(None).cast("array<int>"))
    return out.select("segment_id", "feature_class", "is_test", c.alias("predicted_class"), m.alias("prediction_margin"))


@query()
def rf_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, "rf", n_estimators=20, max_depth=6)


@query()
def mlp_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, "mlp", hidden_layer_sizes=(16,), max_iter=50)


@query()
def shapley_values(spark: SparkSession, d: str) -> DataFrame:
    cols = [f"f{i}" for i in range(4)]
    f = X.features(spark, d)
    model = classify.fit(f, cols, "rf", n_estimators=10, max_depth=4)
    mean = f.agg(*[F.avg(c) for c in cols]).first()
    return classify.shapley_values(f, "segment_id", cols, classify.forest_votes(model), list(mean), permutations=4)


@query(f"WITH {X.PX}, {X.SEG} SELECT raster_id, row, col, CAST(embeddings.label AS DOUBLE) AS v FROM seg LEFT JOIN embeddings ON vec_id = segment_id")
def classified_raster(spark: SparkSession, d: str) -> DataFrame:
    """The predicted class of each pixel's segment."""
    c = X.features(spark, d).select("segment_id", F.col("feature_class").alias("predicted_class"))
    return classify.classified_raster(X.segments(spark, d), c).select("raster_id", "row", "col", "v")
