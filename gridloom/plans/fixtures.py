"""Rasters, segments, points and boxes derived from the tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.common import table

#: Each hundred embeddings are one raster of 100 rows and 64 columns; on the map the rasters lie below one another.
HEIGHT, WIDTH = 100, 64
RASTER_ID = f"cast(vec_id div {HEIGHT} + 1 as bigint)"
ROW = f"cast(vec_id % {HEIGHT} as int)"
#: Number of a pixel's row on the map, which is the number of its embedding.
MAP_ROW = f"((raster_id - 1) * {HEIGHT} + row)"


def px1(spark: SparkSession, d: str) -> DataFrame:
    """One band: raster_id, row, col, v."""
    e = table(spark, d, "embeddings").select(F.expr(RASTER_ID).alias("raster_id"), F.expr(ROW).alias("row"), F.posexplode("embedding").alias("col", "v"))
    return e.select("raster_id", "row", "col", F.col("v").cast("double").alias("v"))


def px8(spark: SparkSession, d: str) -> DataFrame:
    """Eight bands, long: raster_id, row, col, band, v."""
    return px1(spark, d).select("raster_id", "row", F.expr("int(col div 8)").alias("col"), (F.col("col") % 8).alias("band"), "v")


def wide8(spark: SparkSession, d: str) -> DataFrame:
    """Eight bands, wide: raster_id, row, col, b0..b7; straight from the arrays, without a shuffle."""
    e = table(spark, d, "embeddings").select(F.expr(RASTER_ID).alias("raster_id"), F.expr(ROW).alias("row"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("col"))
    return e.select("raster_id", "row", "col", *[F.get("embedding", F.col("col") * 8 + b).cast("double").alias(f"b{b}") for b in range(8)])


#: Blocks of 20 rows and 8 columns; 40 of them in a raster.
SEGMENT = "cast((raster_id - 1) * 40 + row div 20 * 8 + col div 8 as int)"
#: Strips of 20 rows and all columns.
STRIP = "cast((raster_id - 1) * 5 + row div 20 as int)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Block labels on the one-band raster: raster_id, row, col, v, segment_id."""
    return px1(spark, d).withColumn("segment_id", F.expr(SEGMENT))


def segment_boxes(spark: SparkSession, d: str) -> DataFrame:
    g = segments(spark, d).groupBy("segment_id").agg(F.min("col").alias("x0"), F.min(F.expr(MAP_ROW)).alias("y0"), (F.max("col") + 1).alias("x1"), (F.max(F.expr(MAP_ROW)) + 1).alias("y1"))
    return g.select("segment_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])


def points(spark: SparkSession, d: str) -> DataFrame:
    """id, x, y, class."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), (F.col("vec_id") * 7 % 64 + F.lit(0.5)).cast("double").alias("x"), (F.col("vec_id") * 13 % 500 + F.lit(0.5)).cast("double").alias("y"), (F.col("label") % 3).cast("int").alias("class"))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """id, x, y, height, origin."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice").cast("double") - 900).alias("y"), (2 + (F.col("p_partkey") * 7919 % 2000) / 100.0).cast("double").alias("height"), F.when(F.col("p_partkey") % 2 == 0, "chm").otherwise("density").alias("origin"))


def raster_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds with the raster they belong to."""
    return seeds(spark, d).withColumn("raster_id", (F.col("id") % 5 + 1).cast("long"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """box_id, image_id, x0, y0, x1, y1, score."""
    k = F.col("p_partkey")
    x, y = (k * 37 % 500).cast("double"), (k * 91 % 400).cast("double")
    return table(spark, d, "part").select(k.cast("long").alias("box_id"), (k % 9).cast("long").alias("image_id"), x.alias("x0"), y.alias("y0"), (x + 5 + k % 23).alias("x1"), (y + 5 + k % 17).alias("y1"), (k * 7919 % 1000 / 1000.0).cast("double").alias("score"))


def zones(spark: SparkSession, d: str) -> DataFrame:
    """fid, region_id, box, classes (text), acceptable_classes."""
    k = F.col("s_suppkey")
    x, y = (k * 53 % 450).cast("double"), (k * 29 % 350).cast("double")
    classes = F.concat_ws(",", (k % 5).cast("string"), (k % 7).cast("string"), F.lit("9"))
    return table(spark, d, "supplier").select(k.cast("long").alias("fid"), k.cast("long").alias("region_id"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 60).alias("y1"), classes.alias("classes"), F.transform(F.split(classes, ","), lambda s: s.cast("int")).alias("acceptable_classes"))


def features(spark: SparkSession, d: str, n: int = 4) -> DataFrame:
    """segment_id, f0.., feature_class."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("segment_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(n)], F.col("label").cast("int").alias("feature_class"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """segment_id, y, yhat."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("segment_id"), F.col("label").cast("int").alias("y"), ((F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 10).cast("int").alias("yhat"))


SEED_RASTER = "(id % 5 + 1)"
PX = f"px AS (SELECT vec_id // {HEIGHT} + 1 AS raster_id, CAST(vec_id % {HEIGHT} AS INTEGER) AS row, CAST(unnest(range(len(embedding))) AS INTEGER) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
PX8 = "p8 AS (SELECT raster_id, row, col // 8 AS col, col % 8 AS band, v FROM px)"
W8 = f"w8 AS (SELECT vec_id // {HEIGHT} + 1 AS raster_id, CAST(vec_id % {HEIGHT} AS INTEGER) AS row, CAST(c AS INTEGER) AS col, " + ", ".join(f"CAST(embedding[c * 8 + {b + 1}] AS DOUBLE) AS b{b}" for b in range(8)) + " FROM embeddings, range(8) AS r(c))"
SQL_SEGMENT, SQL_STRIP = "((raster_id - 1) * 40 + row // 20 * 8 + col // 8)", "((raster_id - 1) * 5 + row // 20)"
SEG = f"seg AS (SELECT raster_id, row, col, v, {SQL_SEGMENT} AS segment_id FROM px)"
BOX = f"bx AS (SELECT segment_id, CAST(min(col) AS DOUBLE) AS x0, CAST(min({MAP_ROW}) AS DOUBLE) AS y0, CAST(max(col) + 1 AS DOUBLE) AS x1, CAST(max({MAP_ROW}) + 1 AS DOUBLE) AS y1 FROM seg GROUP BY 1)"
PTS = "pts AS (SELECT vec_id AS id, CAST(vec_id * 7 % 64 + 0.5 AS DOUBLE) AS x, CAST(vec_id * 13 % 500 + 0.5 AS DOUBLE) AS y, CAST(label % 3 AS INTEGER) AS class FROM embeddings)"
SEEDS = "s AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) - 900 AS y, 2 + CAST(p_partkey * 7919 % 2000 AS DOUBLE) / 100 AS height, CASE WHEN p_partkey % 2 = 0 THEN 'chm' ELSE 'density' END AS origin FROM part)"
DET = "b AS (SELECT CAST(p_partkey AS BIGINT) AS box_id, CAST(p_partkey % 9 AS BIGINT) AS image_id, CAST(p_partkey * 37 % 500 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 400 AS DOUBLE) AS y0, CAST(p_partkey * 37 % 500 + 5 + p_partkey % 23 AS DOUBLE) AS x1, CAST(p_partkey * 91 % 400 + 5 + p_partkey % 17 AS DOUBLE) AS y1, CAST(p_partkey * 7919 % 1000 AS DOUBLE) / 1000 AS score FROM part)"
ZONES = "z AS (SELECT CAST(s_suppkey AS BIGINT) AS fid, CAST(s_suppkey * 53 % 450 AS DOUBLE) AS x0, CAST(s_suppkey * 29 % 350 AS DOUBLE) AS y0, CAST(s_suppkey * 53 % 450 + 60 AS DOUBLE) AS x1, CAST(s_suppkey * 29 % 350 + 60 AS DOUBLE) AS y1, concat_ws(',', s_suppkey % 5, s_suppkey % 7, '9') AS classes FROM supplier)"
PAIRS = "q AS (SELECT vec_id AS segment_id, CAST(label AS INTEGER) AS y, CAST((label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS INTEGER) AS yhat FROM embeddings)"


def sql_normalise(name: str, source: str, value: str, out: str) -> str:
    """CTE of the 2/98 percentile normalisation of each raster, missing values at 0."""
    return f"{name}_p AS (SELECT raster_id, quantile_cont({value}, 0.02) AS p, quantile_cont({value}, 0.98) AS q FROM {source} GROUP BY 1), {name} AS (SELECT s.*, CASE WHEN {value} IS NULL OR q = p THEN 0.0 ELSE (least(greatest({value}, p), q) - p) / (q - p) END AS {out} FROM {source} s JOIN {name}_p USING (raster_id))"


def sql_sobel(name: str, source: str, value: str) -> str:
    w, c = "(PARTITION BY raster_id, row ORDER BY col)", "(PARTITION BY raster_id, col ORDER BY row)"
    return f"""{name}_a AS (SELECT raster_id, row, col, coalesce(lead({value}) OVER {w}, {value}) - coalesce(lag({value}) OVER {w}, {value}) AS d, coalesce(lag({value}) OVER {w}, {value}) + 2 * {value} + coalesce(lead({value}) OVER {w}, {value}) AS s FROM {source}),
{name}_b AS (SELECT raster_id, row, col, coalesce(lag(d) OVER {c}, d) + 2 * d + coalesce(lead(d) OVER {c}, d) AS gx, coalesce(lead(s) OVER {c}, s) - coalesce(lag(s) OVER {c}, s) AS gy FROM {name}_a),
{name} AS (SELECT raster_id, row, col, sqrt(gx * gx + gy * gy) AS gradient FROM {name}_b)"""


def sql_edges(name: str, source: str, label: str) -> str:
    return f"{name} AS (SELECT raster_id, row, col, CASE WHEN coalesce(lead({label}) OVER (PARTITION BY raster_id, row ORDER BY col) <> {label}, FALSE) OR coalesce(lead({label}) OVER (PARTITION BY raster_id, col ORDER BY row) <> {label}, FALSE) THEN 1 ELSE 0 END AS edge FROM {source})"


def sql_entropy(name: str, source: str, value: str) -> str:
    return f"""{name}_o AS (SELECT r.i AS dr, c.i AS dc FROM range(-3, 4) r(i), range(-3, 4) c(i) WHERE r.i * r.i + c.i * c.i <= 9),
{name}_n AS (SELECT a.raster_id, a.row, a.col, b.{value} AS q, count(*) AS n FROM {source} a, {name}_o o, {source} b WHERE b.raster_id = a.raster_id AND b.row = a.row + o.dr AND b.col = a.col + o.dc GROUP BY 1, 2, 3, 4),
{name}_t AS (SELECT raster_id, row, col, sum(n) AS t FROM {name}_n GROUP BY 1, 2, 3),
{name} AS (SELECT n.raster_id, n.row, n.col, -sum(n * 1.0 / t * log2(n * 1.0 / t)) + 0.0 AS entropy FROM {name}_n n JOIN {name}_t t USING (raster_id, row, col) GROUP BY 1, 2, 3)"""


def sql_reflect(i: str, n: str, twice: bool) -> str:
    """A mirrored index in [0, n); ``twice`` repeats the border cell."""
    low, high = (f"-1 - ({i})", f"2 * {n} - 1 - ({i})") if twice else (f"-({i})", f"2 * {n} - 2 - ({i})")
    return f"CASE WHEN {i} < 0 THEN {low} WHEN {i} >= {n} THEN {high} ELSE {i} END"
