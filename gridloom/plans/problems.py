"""Queries on filling missing values (4) and on points near points or regions (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.common import is_finite, table
from gridloom.functions.crs import BETA, DELTA, RADIUS, SCALE, to_crs
from gridloom.functions.current import current_statistics
from gridloom.functions.wkt import point_x, point_y
from gridloom.operators.fill import fill_missing, filled_values
from gridloom.operators.near import EARTH_RADIUS_M, outlines, pairs_within, points_in_outlines, radius_join
from gridloom.operators.seeds import eps_of

FILL_FIELDS = ["b0_mean", "b0_contrast", "b0_correlation"]
#: Same raster and day of the run with five known values, else the raster.
FILL_LEVELS = [(["raster_id", "day"], 5), (["raster_id"], 1)]
SEED_RADIUS = 2.5


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current_statistics(spark, sf_dir, FILL_FIELDS).withColumn("day", F.to_date("computed_at"))
    return fill_missing(rows, {f: "median" for f in FILL_FIELDS}, FILL_LEVELS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_values(_filled(spark, sf_dir), "segment_id", FILL_FIELDS).select("segment_id", "field_name")


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current statistics of every segment, filled and marked."""
    return _filled(spark, sf_dir).select("segment_id", "raster_id", *[c for f in FILL_FIELDS for c in (f, f"{f}_filled", f"{f}_level")])


def p4_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that cannot be filled."""
    return filled_values(_filled(spark, sf_dir), "segment_id", FILL_FIELDS, "left").select("segment_id", "field_name")


def p4_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categorical case: missing languages of documents filled by the mode of the same docket (two known ones), else of the court."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "docket", "court", "lang")
    filled = fill_missing(rows, {"lang": "mode"}, [(["court", "docket"], 2), (["court"], 1)])
    return filled.where("lang_filled or lang is null").select("doc_id", "lang", "lang_filled", "lang_level")


def points(df: DataFrame, id_column: str) -> DataFrame:
    """id, x, y of a table with a WKT point in ``geometry``."""
    return df.select(F.col(id_column).cast("long").alias("id"), point_x(F.col("geometry")).alias("x"), point_y(F.col("geometry")).alias("y"))


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_in_outlines(points(table(spark, sf_dir, "labelled_points"), "point_id"), outlines(table(spark, sf_dir, "segments"), "segment_id", "geometry"))


def _seed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_within(points(table(spark, sf_dir, "seeds"), "id"), SEED_RADIUS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = _contained(spark, sf_dir).select(F.lit("point_in_segment").alias("kind"), F.col("point_id").alias("left_id"), F.col("segment_id").alias("right_id"))
    pairs = _seed_pairs(spark, sf_dir).select(F.lit("seed_pair").alias("kind"), "left_id", "right_id")
    return inside.unionByName(pairs)


def p5_seed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seed with the number of seeds within the radius."""
    pairs = _seed_pairs(spark, sf_dir)
    ends = pairs.select(F.col("left_id").alias("id")).unionByName(pairs.select(F.col("right_id").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return points(table(spark, sf_dir, "seeds"), "id").select("id").distinct().join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("neighbours"))


def p5_crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree seed with the seeds inside its crown, of a radius of its own: a tenth of its height, 0.5 to 3 m."""
    t = table(spark, sf_dir, "seeds")
    place = points(t, "id").distinct()
    heights = t.groupBy("id").agg(F.max("ch_max").alias("ch_max"))
    tall = place.join(heights, "id").where(is_finite(F.col("ch_max"))).withColumn("r", eps_of(F.col("ch_max"), 0.1, 0.5, 3.0))
    inside = radius_join(tall, place).where("left_id <> right_id")
    return inside.groupBy(F.col("left_id").alias("id")).agg(F.count_distinct("right_id").alias("inside"))


def p5_sphere_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of seeds at most 2.6 m apart on the great circle: map coordinates read as UTM zone 4 north, in degrees."""
    degrees = to_crs(points(table(spark, sf_dir, "seeds"), "id"), "EPSG:32604", "EPSG:4326")
    return pairs_within(degrees, 2.6, "great_circle").select("left_id", "right_id").distinct()


QUERIES = {f.__name__: f for f in (p4_found, p4_filled, p4_left, p4_category, p5_found, p5_seed_neighbours, p5_crowns, p5_sphere_pairs)}

_CURRENT = """WITH cs AS (SELECT DISTINCT s.segment_id, s.raster_id, s.computed_at, s.b0_mean, s.b0_contrast, s.b0_correlation FROM segment_statistics s JOIN (SELECT segment_id, max(computed_at) AS m FROM segment_statistics GROUP BY 1) l ON s.segment_id = l.segment_id AND s.computed_at = l.m),
u AS (SELECT cs.segment_id, cs.raster_id, CAST(cs.computed_at AT TIME ZONE 'UTC' AS DATE) AS day, f.field_name, CASE WHEN isfinite(f.v) AND (r.nodata IS NULL OR isnan(r.nodata) OR f.v <> r.nodata) THEN f.v END AS v
 FROM cs LEFT JOIN rasters r USING (raster_id), LATERAL (VALUES ('b0_mean', cs.b0_mean), ('b0_contrast', cs.b0_contrast), ('b0_correlation', cs.b0_correlation)) AS f(field_name, v)),
k AS (SELECT raster_id, field_name, quantile_disc(v, 0.5) AS m FROM u WHERE v IS NOT NULL GROUP BY 1, 2),
kd AS (SELECT raster_id, day, field_name, quantile_disc(v, 0.5) AS m FROM u WHERE v IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5)"""
_NUM = "[-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?"
_POINT = f"(?i)POINT[ ZM]*[(][ ]*({_NUM}) +({_NUM})"
_SEEDS = f"s AS (SELECT DISTINCT id, CAST(nullif(regexp_extract(geometry, '{_POINT}', 1), '') AS DOUBLE) AS x, CAST(nullif(regexp_extract(geometry, '{_POINT}', 2), '') AS DOUBLE) AS y FROM seeds)"
_PAIRS = "sp AS (SELECT a.id AS left_id, b.id AS right_id FROM s a JOIN s b ON a.id < b.id AND b.x BETWEEN a.x - 2.6 AND a.x + 2.6 AND b.y BETWEEN a.y - 2.6 AND a.y + 2.6 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2.5 + 1e-9)"

_ETA_XI = " - ".join(["xi", *[f"{b!r} * sin({2 * (j + 1)} * xi) * cosh({2 * (j + 1)} * eta)" for j, b in enumerate(BETA)]]), " - ".join(["eta", *[f"{b!r} * cos({2 * (j + 1)} * xi) * sinh({2 * (j + 1)} * eta)" for j, b in enumerate(BETA)]])
_LAT = " + ".join(["chi", *[f"{d!r} * sin({2 * (j + 1)} * chi)" for j, d in enumerate(DELTA)]])

SQL = {
    "p4_category": """WITH k AS (SELECT court, docket, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL),
d AS (SELECT court, docket, arg_min(lang, (-n, lang)) AS lang FROM k WHERE court IS NOT NULL AND docket IS NOT NULL GROUP BY 1, 2 HAVING sum(n) >= 2),
c AS (SELECT court, arg_min(lang, (-n, lang)) AS lang FROM (SELECT court, lang, sum(n) AS n FROM k WHERE court IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT x.doc_id, coalesce(d.lang, c.lang) AS lang, coalesce(d.lang, c.lang) IS NOT NULL AS lang_filled, CASE WHEN d.lang IS NOT NULL THEN 0 WHEN c.lang IS NOT NULL THEN 1 END AS lang_level
FROM documents x LEFT JOIN d ON d.court = x.court AND d.docket = x.docket LEFT JOIN c ON c.court = x.court WHERE x.lang IS NULL""",
    "p5_crowns": f"""WITH {_SEEDS}, h AS (SELECT id, max(CASE WHEN isnan(ch_max) THEN 'inf'::DOUBLE ELSE ch_max END) AS m FROM seeds GROUP BY 1), q AS (SELECT s.id, x, y, least(greatest(m * 0.1::DOUBLE, 0.5), 3.0) AS r FROM s JOIN h USING (id) WHERE isfinite(m))
SELECT q.id, count(DISTINCT s.id) AS inside FROM q JOIN s ON s.id <> q.id AND s.x BETWEEN q.x - 3.1 AND q.x + 3.1 AND s.y BETWEEN q.y - 3.1 AND q.y + 3.1 WHERE sqrt((s.x - q.x) * (s.x - q.x) + (s.y - q.y) * (s.y - q.y)) <= q.r + 1e-9 GROUP BY 1""",
    "p5_sphere_pairs": f"""WITH {_SEEDS}, a AS (SELECT id, x, y, y / {SCALE * RADIUS!r} AS xi, (x - 500000) / {SCALE * RADIUS!r} AS eta FROM s WHERE x IS NOT NULL), b AS (SELECT id, x, y, {_ETA_XI[0]} AS x1, {_ETA_XI[1]} AS e1 FROM a), c AS (SELECT *, asin(sin(x1) / cosh(e1)) AS chi FROM b),
g AS (SELECT id, x, y, atan(sinh(e1) / cos(x1)) AS lon, {_LAT} AS lat FROM c)
SELECT DISTINCT p.id AS left_id, q.id AS right_id FROM g p JOIN g q ON p.id < q.id AND q.x BETWEEN p.x - 2.7 AND p.x + 2.7 AND q.y BETWEEN p.y - 2.7 AND p.y + 2.7
WHERE 2 * {EARTH_RADIUS_M} * asin(sqrt(power(sin((q.lat - p.lat) / 2), 2) + cos(p.lat) * cos(q.lat) * power(sin((q.lon - p.lon) / 2), 2))) <= 2.6 + 1e-9""",
    "p4_found": f"{_CURRENT} SELECT u.segment_id, u.field_name FROM u JOIN k USING (raster_id, field_name) WHERE u.v IS NULL",
    "p4_left": f"{_CURRENT} SELECT u.segment_id, u.field_name FROM u LEFT JOIN k USING (raster_id, field_name) WHERE u.v IS NULL AND k.m IS NULL",
    "p4_filled": f"""{_CURRENT}, z AS (SELECT u.segment_id, u.raster_id, u.field_name, coalesce(u.v, kd.m, k.m) AS v, u.v IS NULL AND k.m IS NOT NULL AS filled, CASE WHEN u.v IS NULL THEN CASE WHEN kd.m IS NOT NULL THEN 0 WHEN k.m IS NOT NULL THEN 1 END END AS level
 FROM u LEFT JOIN k ON k.raster_id = u.raster_id AND k.field_name = u.field_name LEFT JOIN kd ON kd.raster_id = u.raster_id AND kd.field_name = u.field_name AND kd.day = u.day)
SELECT segment_id, raster_id, """
    + ", ".join(f"max(v) FILTER (WHERE field_name = '{f}') AS {f}, bool_or(filled) FILTER (WHERE field_name = '{f}') AS {f}_filled, CAST(max(level) FILTER (WHERE field_name = '{f}') AS INTEGER) AS {f}_level" for f in FILL_FIELDS)
    + " FROM z GROUP BY 1, 2",
    "p5_found": f"""WITH {_SEEDS}, {_PAIRS},
pt AS (SELECT DISTINCT point_id, CAST(nullif(regexp_extract(geometry, '{_POINT}', 1), '') AS DOUBLE) AS x, CAST(nullif(regexp_extract(geometry, '{_POINT}', 2), '') AS DOUBLE) AS y FROM labelled_points),
rings AS (SELECT segment_id, row_number() OVER () AS ring_id, ring FROM (SELECT segment_id, unnest(regexp_extract_all(geometry, '[(]([^()]+)[)]', 1)) AS ring FROM (SELECT DISTINCT segment_id, geometry FROM segments WHERE geometry IS NOT NULL))),
v AS (SELECT segment_id, ring_id, i, CAST(string_split_regex(trim(c), ' +')[1] AS DOUBLE) AS x, CAST(string_split_regex(trim(c), ' +')[2] AS DOUBLE) AS y FROM (SELECT segment_id, ring_id, unnest(range(1, len(cs) + 1)) AS i, unnest(cs) AS c FROM (SELECT segment_id, ring_id, string_split(ring, ',') AS cs FROM rings))),
e AS (SELECT segment_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY ring_id ORDER BY i)),
bb AS (SELECT segment_id, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by FROM v GROUP BY 1),
c AS (SELECT pt.point_id, pt.x, pt.y, bb.segment_id FROM pt JOIN bb ON pt.x BETWEEN bb.ax AND bb.bx AND pt.y BETWEEN bb.ay AND bb.by),
h AS (SELECT c.point_id, c.segment_id, sum(CASE WHEN (e.y0 > c.y) <> (e.y1 > c.y) AND ((e.x1 - e.x0) * (c.y - e.y0) - (e.y1 - e.y0) * (c.x - e.x0) > 0) = (e.y1 > e.y0) THEN 1 ELSE 0 END) AS crossings,
 max(CASE WHEN (e.x1 - e.x0) * (c.y - e.y0) = (e.y1 - e.y0) * (c.x - e.x0) AND c.x BETWEEN least(e.x0, e.x1) AND greatest(e.x0, e.x1) AND c.y BETWEEN least(e.y0, e.y1) AND greatest(e.y0, e.y1) THEN 1 ELSE 0 END) AS edge
 FROM c JOIN e ON e.segment_id = c.segment_id AND e.x1 IS NOT NULL GROUP BY 1, 2)
SELECT DISTINCT 'point_in_segment' AS kind, point_id AS left_id, segment_id AS right_id FROM h WHERE crossings % 2 = 1 OR edge = 1
UNION ALL SELECT DISTINCT 'seed_pair', left_id, right_id FROM sp""",
    "p5_seed_neighbours": f"""WITH {_SEEDS}, {_PAIRS}, n AS (SELECT id, count(*) AS c FROM (SELECT DISTINCT left_id AS id, right_id AS o FROM sp UNION ALL SELECT DISTINCT right_id, left_id FROM sp) GROUP BY 1)
SELECT DISTINCT s.id, coalesce(n.c, 0) AS neighbours FROM s LEFT JOIN n USING (id)""",
}
