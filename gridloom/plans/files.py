"""Queries on files and whole jobs: rasters and features written and read again, pipelines, small operators."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import pipelines
from gridloom.common import local_path, shared_root, table
from gridloom.functions.wkt import point_x, point_y
from gridloom.operators import classify, cost, detect, raster, seeds, segment, spatial
from gridloom.operators.near import outline_measures, outlines
from gridloom.plans import fixtures as X
from gridloom.plans import reference as R
from gridloom.sources import geotiff, gpkg

QUERIES: dict = {}
SQL: dict[str, str] = {}
GT = (0.5, 0, 200000, 0, -0.5, 1000000)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, taken away when the driver ends."""
    folder = f"{local_path(shared_root(spark))}/gridloom-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, True)
    return folder


def through_geotiff(spark: SparkSession, px: DataFrame, dtype: str = "float32") -> str:
    """The folder of the rasters raster_id, [band,] row, col, v, written."""
    folder = shared_folder(spark)
    px = px if "band" in px.columns else px.withColumn("band", F.lit(0))
    geotiff.write_geotiff(px, folder, GT, 32604, dtype=dtype).write.format("noop").mode("overwrite").save()
    return folder


def raster_of_file() -> Column:
    return F.regexp_extract("path", "([0-9]+)[.]tif$", 1).cast("long").alias("raster_id")


@query(f"WITH {X.PX}, {X.PX8} SELECT raster_id, band, row, col, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM p8")
def geotiff_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rasters written as GeoTIFF and read again."""
    return geotiff.read_geotiff(spark, through_geotiff(spark, X.px8(spark, d))).select(raster_of_file(), "band", "row", "col", "v")


@query(f"WITH {X.PX}, {X.PX8} SELECT raster_id, row, col, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM p8 WHERE band = 3 AND row >= 20 AND row < 60")
def read_band(spark: SparkSession, d: str) -> DataFrame:
    """One band and a window of files; both reach the source."""
    return geotiff.read_geotiff(spark, through_geotiff(spark, X.px8(spark, d)), bands=[3]).where("row >= 20 and row < 60").select(raster_of_file(), "row", "col", "v")


@query(f"WITH {X.PX} SELECT raster_id, row, col, 200000 + col * 0.5::DOUBLE AS x, 1000000 - row * 0.5::DOUBLE AS y FROM px WHERE v > 0.25")
def binary_mask(spark: SparkSession, d: str) -> DataFrame:
    """Mask rasters written as bytes; their cells that are not zero, with the corner of each by the file's own affine."""
    folder = through_geotiff(spark, X.px1(spark, d).withColumn("v", (F.col("v") > 0.25).cast("double")), "int16")
    mask = geotiff.read_mask(spark, folder).select(raster_of_file(), "row", "col")
    x, y = raster.pixel_to_map(F.col("col"), F.col("row"), GT)
    return mask.select("raster_id", "row", "col", x.alias("x"), y.alias("y"))


@query(f"WITH {X.PX} SELECT raster_id || '.tif' AS name, CAST(max(col) + 1 AS INTEGER) AS width, CAST(max(row) + 1 AS INTEGER) AS height, 1 AS n_bands, 'EPSG:32604' AS crs, 200000::DOUBLE AS minx, 1000000 - (max(row) + 1) * 0.5::DOUBLE AS miny, 200000 + (max(col) + 1) * 0.5::DOUBLE AS maxx, 1000000::DOUBLE AS maxy FROM px GROUP BY raster_id")
def raster_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder with their size, system and bounds."""
    files = geotiff.files_of(spark, through_geotiff(spark, X.px1(spark, d)))
    paths = [r.path for r in files.select("path").collect()]  # names of files, as a scan plans them
    return geotiff.catalog(spark, paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), "width", "height", "n_bands", "crs", "minx", "miny", "maxx", "maxy")


@query(f"""WITH {R._COST_PARTS} SELECT raster_id, row, col, round(CAST(CAST(least(greatest(0.4 * grad + 0.2 * gap + 0.2 * tex + 0.2 * border, 0), 1) AS FLOAT) AS DOUBLE), 4) AS cost
FROM gn JOIN gq USING (raster_id, row, col) JOIN tx USING (raster_id, row, col) JOIN eb USING (raster_id, row, col)""")
def cost_geotiff(spark: SparkSession, d: str) -> DataFrame:
    """Cost surfaces written as rasters and read again."""
    image = X.wide8(spark, d)
    labels = image.select("raster_id", "row", "col", F.expr("int(row div 20) * 2 + int(col div 4)").alias("label"))
    out = cost.cost_surface(image, image.select("raster_id", "row", "col", F.col("b7").alias("v")), labels, (0.4, 0.2, 0.2, 0.2))
    back = geotiff.read_geotiff(spark, through_geotiff(spark, out.withColumnRenamed("cost", "v")))
    return back.select(raster_of_file(), "row", "col", (F.round("v", 4) + F.lit(0.0)).alias("cost"))


_GREY = "w AS (SELECT raster_id, min(b1) AS a1, max(b1) AS z1, min(b2) AS a2, max(b2) AS z2, min(b4) AS a4, max(b4) AS z4 FROM w8 GROUP BY 1), px AS (SELECT raster_id, row, col, 0.299 * (b1 - a1) / (z1 - a1) + 0.587 * (b2 - a2) / (z2 - a2) + 0.114 * (b4 - a4) / (z4 - a4) AS v FROM w8 JOIN w USING (raster_id))"


@query(f"WITH {X.W8}, {_GREY}, {R._DIMS}, {R._LAP}, {R._VAR}, {X.sql_normalise('n', 'va', 'variance', 'sharpness')} SELECT raster_id, row, col, round(CAST(CAST(sharpness AS FLOAT) AS DOUBLE), 4) AS sharpness FROM n")
def sharpness_geotiff(spark: SparkSession, d: str) -> DataFrame:
    """Sharpness from raw bands, written as rasters and read again."""
    out = pipelines.laplacian(X.px8(spark, d), (1, 2, 4), 5)
    back = geotiff.read_geotiff(spark, through_geotiff(spark, out.select("raster_id", "row", "col", F.col("sharpness").alias("v"))))
    return back.select(raster_of_file(), "row", "col", (F.round("v", 4) + F.lit(0.0)).alias("sharpness"))


@query(f"WITH {X.PX}, {X.SEG} SELECT raster_id, row, col, CAST(embeddings.label AS DOUBLE) AS v FROM seg LEFT JOIN embeddings ON vec_id = segment_id")
def classified_geotiff(spark: SparkSession, d: str) -> DataFrame:
    """Classified segments written as rasters and read again."""
    c = X.features(spark, d).select("segment_id", F.col("feature_class").alias("predicted_class"))
    return geotiff.read_geotiff(spark, through_geotiff(spark, classify.classified_raster(X.segments(spark, d), c))).select(raster_of_file(), "row", "col", "v")


@query("SELECT segment_id, raster_id, site_id, count(*) AS n FROM segments WHERE geometry IS NOT NULL AND NOT contains(geometry, 'EMPTY') GROUP BY ALL")
def gpkg_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as GeoPackage and read again."""
    folder = shared_folder(spark)
    gpkg.write_gpkg(table(spark, d, "segments").select("segment_id", "raster_id", "site_id", "geometry"), folder, "segments", 32604).write.format("noop").mode("overwrite").save()
    return gpkg.read_gpkg(spark, folder).where("geometry is not null").groupBy("segment_id", "raster_id", "site_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X.SEEDS} SELECT id, x, y, height FROM s WHERE x BETWEEN 10 AND 30 AND y BETWEEN 20 AND 70")
def seeds_gpkg(spark: SparkSession, d: str) -> DataFrame:
    """Seeds written twice over as points of a GeoPackage, and those in a box read again."""
    folder = shared_folder(spark)
    s = X.seeds(spark, d).select("id", "height", F.format_string("POINT (%s %s)", F.col("x").cast("string"), F.col("y").cast("string")).alias("geometry"))
    for _ in range(2):
        gpkg.write_gpkg(s, folder, "canonical_seeds", 32604, overwrite=True).write.format("noop").mode("overwrite").save()
    back = gpkg.read_gpkg(spark, folder, "canonical_seeds", (10, 20, 30, 70))
    return back.select("id", point_x(F.col("geometry")).alias("x"), point_y(F.col("geometry")).alias("y"), "height")


@query(f"""WITH {X.DET}, {R._TR}, j AS (SELECT * FROM (SELECT *, 'tile_' || (box_id % 7) AS tile_name FROM b) JOIN tr USING (tile_name))
SELECT box_id, tile_name, round((x1 - x0) * 0.5 * (y1 - y0) * 0.5, 4) AS area, 0.5 * x0 + c AS minx, -0.5 * y0 + f AS maxy, 'Tree' AS label FROM j""")
def predictions_gpkg(spark: SparkSession, d: str) -> DataFrame:
    """Predicted boxes of tiles as map polygons in a GeoPackage, read again and measured."""
    k = F.col("r_regionkey")
    t = table(spark, d, "region").select(F.concat(F.lit("tile_"), k.cast("string")).alias("tile_name"), F.array(F.lit(0.5), F.lit(0.0), 200000.0 + k * 1000, F.lit(0.0), F.lit(-0.5), F.lit(1000000.0)).alias("transform"), F.lit("EPSG:32604").alias("crs"))
    boxes = detect.georeference(X.boxes(spark, d).withColumn("tile_name", F.concat(F.lit("tile_"), (F.col("box_id") % 7).cast("string"))), t)
    folder = shared_folder(spark)
    gpkg.write_gpkg(detect.box_polygons(boxes).select("box_id", "tile_name", "label", "score", "geometry"), folder, "predictions", 32604).write.format("noop").mode("overwrite").save()
    back = gpkg.read_gpkg(spark, folder)
    m = outline_measures(outlines(back, "box_id", "geometry"))
    return back.select("box_id", "tile_name", "label").join(m.select(F.col("id").alias("box_id"), F.round("area", 4).alias("area"), "minx", "maxy"), "box_id")


@query(f"WITH {X.PX} SELECT raster_id, count(*) AS pixels, round(count(*) * 0.25::DOUBLE, 4) AS area FROM px GROUP BY 1")
def tiled_segments_gpkg(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the checkerboard written as outlines and read again: their pixels and area cover each raster."""
    t = segment.tiled_segments(X.px1(spark, d), ["v"], tile=32, buffer=6, crown_radius=3)
    regions = segment.connected_regions(t, "segment_id", tile=64)
    folder = shared_folder(spark)
    sizes = regions.groupBy("raster_id", "region").agg(F.count(F.lit(1)).alias("pixels"))
    shapes = segment.outlines_wkt(regions, GT).join(sizes, ["raster_id", "region"]).withColumn("segment_id", F.col("raster_id") * 1_000_000 + F.col("region"))
    gpkg.write_gpkg(shapes.select("segment_id", "raster_id", "pixels", "geometry"), folder, "segments", 32604).write.format("noop").mode("overwrite").save()
    back = gpkg.read_gpkg(spark, folder)
    m = outline_measures(outlines(back, "segment_id", "geometry")).select(F.col("id").alias("segment_id"), "area")
    return back.join(m, "segment_id").groupBy("raster_id").agg(F.sum("pixels").alias("pixels"), F.round(F.sum("area"), 4).alias("area"))


# Whole jobs


@query(f"WITH {X.W8} SELECT raster_id, count(*) AS pixels, round(count(*) * 0.25::DOUBLE, 4) AS area, round(sum(b0), 4) AS total, TRUE AS numbered, CAST(0 AS BIGINT) AS bare FROM w8 GROUP BY 1")
def segment_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Images segmented, measured and outlined in one call; what must hold for the objects of each raster."""
    wide = X.wide8(spark, d)
    labels, objects = pipelines.segment_image(wide, [0, 1, 2], [0, 3], [0], gt=GT, n_segments=60, iterations=4)
    sizes = labels.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))
    m = outline_measures(outlines(objects, "segment_id", "geometry")).select(F.col("id").alias("segment_id"), "area")
    j = objects.join(sizes, "segment_id").join(m, "segment_id")
    per = j.groupBy("raster_id").agg(F.sum("n").alias("pixels"), F.round(F.sum("area"), 4).alias("area"), F.round(F.sum(F.col("b0_mean") * F.col("n")), 4).alias("total"), F.count_if(F.col("b3_mean").isNull()).alias("bare"))
    counts = objects.agg((F.max("segment_id") == F.count_distinct("segment_id")).alias("numbered"))
    return per.join(counts).select("raster_id", "pixels", "area", "total", "numbered", "bare")  # one row


@query("SELECT count(*) AS segments, count(*) AS predicted, CAST(ceil(0.4 * count(*)) AS BIGINT) AS tested, TRUE AS acceptable, TRUE AS shares_add_up FROM embeddings")
def classify_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Segments classified within acceptable classes in one call; what must hold for predictions, reports and attributions."""
    names = [f"f{i}" for i in range(6)]
    f = X.features(spark, d, 6)
    ok = f.select("segment_id", F.when(F.col("segment_id") % 3 == 0, F.array(F.lit(1), F.lit(3), F.lit(6))).alias("acceptable_classes"))
    out = pipelines.classify(f.drop("feature_class"), f, names, "rf", 0.4, ok, True, n_estimators=8, max_depth=4)
    right = F.col("predicted_class").isNotNull() & (F.col("acceptable_classes").isNull() | F.array_contains("acceptable_classes", F.col("predicted_class").cast("int")))
    one = out.segments.join(ok, "segment_id").agg(F.count(F.lit(1)).alias("segments"), F.count("predicted_class").alias("predicted"), F.min(right).alias("acceptable"))
    tested = out.confusion.agg(F.sum("n").cast("long").alias("tested"))
    whole = out.attributions.groupBy("segment_id").agg(F.abs(F.sum("value")).alias("s")).agg((F.max("s") < 1e-6).alias("shares_add_up"))  # votes of all classes add up to 1 anywhere
    return one.join(tested).join(whole)  # one row each


@query(f"""WITH {X.PX}, {X.PX8}, bx AS (SELECT CAST(p_partkey AS BIGINT) AS box_id, p_partkey % 5 + 1 AS raster_id, p_partkey * 3 % 6 AS x0, p_partkey * 7 % 90 AS y0 FROM part),
t AS (SELECT raster_id, 24 * k AS row0, least(32, 100 - 24 * k) AS h FROM (SELECT DISTINCT raster_id FROM px), range(5) r(k))
SELECT raster_id, CAST(row0 AS DOUBLE) AS row0, any_value(h * 64) AS cells, count(*) AS boxes, sum(y0 - row0) AS offsets, 0 AS least, 254 AS most FROM t JOIN bx USING (raster_id) WHERE y0 >= row0 AND y0 + 4 <= row0 + h GROUP BY 1, 2""")
def training_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Training tiles with annotations and transforms written and read again, summed up."""
    k = F.col("p_partkey")
    x, y = (k * 3 % 6).cast("double"), (k * 7 % 90).cast("double")
    boxes = table(spark, d, "part").select(k.cast("long").alias("box_id"), (k % 5 + 1).cast("long").alias("raster_id"), x.alias("x0"), y.alias("y0"), (x + 2).alias("x1"), (y + 4).alias("y1"))
    t = pipelines.training_tiles(X.px8(spark, d), boxes, 32, 8, GT, "EPSG:32604", shared_folder(spark))
    row0 = (1000000 - F.col("transform")[5]) * 2
    offsets = F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b[1]).cast("long")
    return t.select("raster_id", row0.alias("row0"), F.size("pixels").cast("long").alias("cells"), F.size("boxes").cast("long").alias("boxes"), offsets.alias("offsets"), F.array_min("pixels").alias("least"), F.array_max("pixels").alias("most"))


# Small operators


@query("SELECT user_id AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1")
def mean_losses(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss of each epoch."""
    e = table(spark, d, "events").select(F.col("user_id").alias("epoch"), F.col("value").alias("loss"))
    return detect.mean_losses(e).withColumn("loss", F.round("loss", 6) + F.lit(0.0))


@query(f"WITH {X.ZONES} SELECT fid FROM z WHERE fid % 4 IN (1, 2)")
def included_features(spark: SparkSession, d: str) -> DataFrame:
    """Features that are to be worked on."""
    marks = F.when(F.col("fid") % 4 == 0, "no").when(F.col("fid") % 4 == 1, "yes").when(F.col("fid") % 4 == 2, "yes, late")
    return detect.included(X.zones(spark, d).select("fid", marks.alias("include"))).select("fid")


@query(f"WITH RINGS SELECT raster_id, min(xa) AS minx, min(ya) AS miny, max(xb) AS maxx, max(yb) AS maxy FROM bb JOIN (SELECT DISTINCT segment_id, raster_id FROM segments) USING (segment_id) GROUP BY 1".replace("RINGS", R._RINGS))
def total_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of all outlines of a raster."""
    s = table(spark, d, "segments")
    m = outline_measures(outlines(s, "segment_id", "geometry")).withColumnRenamed("id", "segment_id")
    return m.join(s.select("segment_id", "raster_id").distinct(), "segment_id").groupBy("raster_id").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


@query("""SELECT raster_id, 3 AS row, 2 AS col, CAST(floor((maxy - (maxy - 3.2 * 0.5)) / 0.5) AS INTEGER) AS back_row, CAST(floor((minx + 2.6 * 0.5 - minx) / 0.5) AS INTEGER) AS back_col, minx, maxy - 100 * 0.5::DOUBLE AS miny, minx + 64 * 0.5::DOUBLE AS maxx, maxy FROM rasters""")
def raster_affines(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of rasters of 100 x 64 cells at their own corner, and the cell that holds a place inside."""
    corner = F.col("minx"), F.col("maxy")
    r = table(spark, d, "rasters").select("raster_id", "minx", "maxy")
    row, col = raster.map_to_pixel(corner[0] + 2.6 * 0.5, corner[1] - 3.2 * 0.5, (0.5, 0, corner[0], 0, -0.5, corner[1]))
    bounds = raster.raster_bounds(F.lit(64), F.lit(100), (0.5, 0, corner[0], 0, -0.5, corner[1]))
    return r.select("raster_id", F.lit(3).alias("row"), F.lit(2).alias("col"), row.alias("back_row"), col.alias("back_col"), *[b.alias(n) for b, n in zip(bounds, ("minx", "miny", "maxx", "maxy"))])


@query(f"WITH {X.PX}, {X.SEG} SELECT raster_id, segment_id, count(*) AS pixels FROM seg GROUP BY 1, 2")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a label image with their pixels."""
    return segment.label_counts(X.segments(spark, d), "segment_id")


@query(f"WITH {X.ZONES} SELECT fid, unnest(list_transform(string_split(classes, ','), lambda c: CAST(c AS INTEGER))) AS class FROM z")
def class_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Acceptable classes given as text, one a row."""
    return X.zones(spark, d).select("fid", F.explode(spatial.class_array(F.col("classes"))).alias("class"))


@query("SELECT s.segment_id, s.b6_mean FROM segment_statistics s LEFT JOIN rasters r USING (raster_id) WHERE s.b6_mean IS NOT NULL AND isfinite(s.b6_mean) AND (r.nodata IS NULL OR isnan(r.nodata) OR s.b6_mean <> r.nodata)")
def clean_values(spark: SparkSession, d: str) -> DataFrame:
    """Measurements without nulls, NaN, infinities and the raster's nodata value."""
    r = table(spark, d, "rasters").select("raster_id", F.when(~F.isnan("nodata"), F.col("nodata")).alias("nodata"))
    s = table(spark, d, "segment_statistics").select("segment_id", "raster_id", "b6_mean").join(r, "raster_id", "left")
    return raster.clean(s, "b6_mean", F.col("nodata")).where("b6_mean is not null").select("segment_id", "b6_mean")


@query(f"WITH {X.SEEDS} SELECT id, round(least(greatest(height * 0.1, 0.5), 1.5), 9) AS radius FROM s")
def seed_radii(spark: SparkSession, d: str) -> DataFrame:
    """Radii that grow with the height of a seed."""
    return X.seeds(spark, d).select("id", F.round(seeds.eps_of(F.col("height"), 0.1, 0.5, 1.5), 9).alias("radius"))


@query(f"WITH {X.PX} SELECT raster_id, row, col, v FROM px WHERE row >= 20 AND row < 60 AND col >= 8 AND col < 40")
def crop_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of the window that a map box covers."""
    return raster.crop(X.px1(spark, d), *raster.window_of_bounds(200004, 999970, 200020, 999990, GT)).select("raster_id", "row", "col", "v")
