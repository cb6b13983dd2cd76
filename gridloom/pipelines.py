"""Whole jobs put together from the operators: segmenting images, classifying segments, sharpness, training tiles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.common import numbered
from gridloom.operators import classify as C
from gridloom.operators import detect, neighbours, raster, segment, zonal


def segment_image(wide: DataFrame, bands: list[int], statistics: list[int], textural: list[int] | None = None, method: str = "slic", least: int = 4, gt: tuple[float, ...] = (1, 0, 0, 0, 1, 0), **params) -> tuple[DataFrame, DataFrame]:
    """(labels, objects) of a wide relation raster_id, row, col, b0, ...

    ``labels``: raster_id, row, col, segment_id, connected and of ``least`` pixels where there are
    neighbours to join.  ``objects``: segment_id, raster_id, the statistics of the bands, geometry.
    ``method`` "slic" or "quickshift" with the parameters of either; any other is refused.
    Segments are numbered from 1 over all rasters.
    """
    if method not in ("slic", "quickshift"):
        raise ValueError(f"unknown segmentation method {method!r}")
    work = segment.slic if method == "slic" else segment.quickshift
    regions = segment.enforce_connectivity(work(wide, [f"b{b}" for b in bands], **params), least)
    ids = numbered(regions.select("raster_id", "region").distinct(), ["raster_id", "region"], "segment_id", 1)
    labels = regions.join(ids, ["raster_id", "region"]).select("raster_id", "row", "col", "segment_id")
    table = zonal.create_objects(wide.join(labels, ["raster_id", "row", "col"]), statistics, textural if textural is not None else [], textural=bool(textural))
    shapes = segment.outlines_wkt(regions, gt).join(ids, ["raster_id", "region"]).select("segment_id", "raster_id", "geometry")
    return labels, table.join(shapes, "segment_id").select("segment_id", "raster_id", *[c for c in table.columns if c != "segment_id"], "geometry")


class Classified(NamedTuple):
    """Segments with predicted_class and prediction_margin, the two reports over the test rows, and attributions of the training rows."""

    segments: DataFrame
    confusion: DataFrame
    report: DataFrame
    attributions: DataFrame | None


def classify(objects: DataFrame, training: DataFrame, features: list[str], method: str = "rf", test_size: float = 0.2, acceptable: DataFrame | None = None, attributions: bool = False, **params) -> Classified:
    """Fits a model to labelled segments and predicts all of them.

    ``objects``: segment_id and the features; ``training``: segment_id, feature_class, one row a
    segment; null classes are left out.  Features are scaled by the training rows; rows with a null
    feature get no prediction.  ``acceptable``: segment_id, acceptable_classes, limits the classes of
    its segments; a null list limits nothing.  Integers come out as 64-bit, other numbers as doubles.
    """
    known = objects.join(training.where("feature_class is not null").select("segment_id", "feature_class"), "segment_id", "left")
    for f in features:
        known = known.where(F.col(f).isNotNull())
    labelled = C.split(known.where("feature_class is not null").select("segment_id", "feature_class", *features), "segment_id", test_size)
    train = labelled.where("not is_test")
    model = C.fit(C.scale(train, features, train), features, method, **params)
    scaled = C.scale(known.select("segment_id", "feature_class", *features), features, train)
    out = C.predict(model, scaled).select("segment_id", "feature_class", "proba")
    if acceptable is not None:
        out = out.join(acceptable.select("segment_id", F.col("acceptable_classes").alias("_ok")), "segment_id", "left")
    else:
        out = out.withColumn("_ok", F.lit(None).cast("array<int>"))
    cls, margin = C.choose(F.col("proba"), C.class_labels(model), F.col("_ok"))
    predicted = out.select("segment_id", cls.alias("predicted_class"), margin.alias("prediction_margin"))
    tested = labelled.where("is_test").select("segment_id", F.col("feature_class").alias("y")).join(predicted.select("segment_id", F.col("predicted_class").alias("yhat")), "segment_id")
    shap = None
    if attributions and method == "rf":
        rows = C.scale(train.select("segment_id", *features), features, train)
        shap = C.shapley_values(rows, "segment_id", features, C.forest_votes(model), [0.0] * len(features))
    segments = normalise_types(objects.join(predicted, "segment_id", "left"))
    return Classified(segments, C.confusion_matrix(tested), C.classification_report(tested), shap)


def normalise_types(df: DataFrame) -> DataFrame:
    """Integers as 64-bit integers and other numbers as doubles; the rest stays."""
    kind = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
    cast = lambda t: kind.get(t, "double" if t.startswith("decimal") else t)
    return df.select(*[F.col(c).cast(cast(t)).alias(c) if cast(t) != t else F.col(c) for c, t in df.dtypes])


def laplacian(px: DataFrame, bands: tuple[int, int, int] = (1, 2, 4), win: int = 5) -> DataFrame:
    """raster_id, row, col, sharpness: three bands stretched to 0..1 each, weighed to grey, and the local variance of its Laplacian between percentiles."""
    scaled = raster.normalize_band(px.where(F.col("band").isin(*bands)), ["raster_id", "band"])
    r, g, b = (F.max(F.when(F.col("band") == k, F.col("v"))) for k in bands)
    grey = scaled.groupBy("raster_id", "row", "col").agg(raster.gray(r, g, b).alias("v"))
    return neighbours.sharpness(grey, win)


def training_tiles(px: DataFrame, boxes: DataFrame, size: int, overlap: int, gt: tuple[float, ...], crs: str, folder: str | None = None) -> DataFrame:
    """Tiles with whole annotations, ready to train on: raster_id, tile_no, file_name, height, width, bands, pixels, boxes, labels, transform, crs.

    ``px``: raster_id, row, col, band, v; ``boxes``: raster_id, box_id and a box in pixels.  A tile
    is kept if at least one box lies in it whole; its boxes are in its own pixels.  With ``folder``
    the tiles are written there as Parquet by raster, sidecars included, and read again.
    """
    patches = detect.patch_arrays(px, size, overlap)
    frame = patches.select("raster_id", "row0", "col0", *[F.col(c).cast("double").alias(n) for c, n in (("col0", "x0"), ("row0", "y0"))], (F.col("col0") + F.col("width")).cast("double").alias("x1"), (F.col("row0") + F.col("height")).cast("double").alias("y1"))
    from gridloom.operators.spatial import box_join

    inside = box_join(boxes, frame, float(size), keys=["raster_id"]).where("x0 >= r_x0 and x1 <= r_x1 and y0 >= r_y0 and y1 <= r_y1")
    held = inside.groupBy("raster_id", F.col("r_row0").alias("row0"), F.col("r_col0").alias("col0")).agg(
        F.array_sort(F.collect_list(F.struct("box_id", F.array(F.col("x0") - F.col("r_x0"), F.col("y0") - F.col("r_y0"), F.col("x1") - F.col("r_x0"), F.col("y1") - F.col("r_y0")).alias("b")))).alias("_b")
    )
    a, b, c, d, e, f = map(float, gt)
    transform = F.array(F.lit(a), F.lit(b), a * F.col("col0") + b * F.col("row0") + c, F.lit(d), F.lit(e), d * F.col("col0") + e * F.col("row0") + f)
    tiles = patches.join(held, ["raster_id", "row0", "col0"])
    low, high = F.array_min("pixels"), F.array_max("pixels")
    bytes_ = F.transform("pixels", lambda v: ((v - low) / (high - low + 1e-8) * 255).cast("int"))
    out = numbered(tiles, ["raster_id", "row0", "col0"], "tile_no").select(
        "raster_id", "tile_no", F.format_string("img_%03d.jpg", F.col("tile_no")).alias("file_name"), "height", "width", "bands", bytes_.alias("pixels"),
        F.transform("_b", lambda s: s["b"]).alias("boxes"), F.transform("_b", lambda s: F.lit(1)).alias("labels"), transform.alias("transform"), F.lit(crs).alias("crs"),
    )
    if folder is None:
        return out
    out.write.mode("overwrite").partitionBy("raster_id").parquet(folder)
    return out.sparkSession.read.parquet(folder)
