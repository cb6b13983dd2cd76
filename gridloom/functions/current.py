"""Current rows of the imagery tables: latest label, latest statistics, usable values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.common import latest, table, usable


def current_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, site_id, feature_class of each segment's latest label."""
    return latest(table(spark, sf_dir, "training"), "segment_id", ["labelled_at", "loaded_at"], ["site_id", "feature_class"])


def current_statistics(spark: SparkSession, sf_dir: str, fields: list[str]) -> DataFrame:
    """segment_id, raster_id, site_id, computed_at and ``fields`` of each segment's latest run; unusable values are null."""
    rows = latest(table(spark, sf_dir, "segment_statistics"), "segment_id", ["computed_at", "loaded_at"], ["raster_id", "site_id", "computed_at", *fields])
    nodata = table(spark, sf_dir, "rasters").where("raster_id is not null").groupBy(F.col("raster_id").alias("_raster")).agg(F.max("nodata").alias("_nodata"))
    joined = rows.join(nodata, rows.raster_id == nodata["_raster"], "left")
    return joined.select("segment_id", "raster_id", "site_id", "computed_at", *[F.when(usable(F.col(f), F.col("_nodata")), F.col(f)).alias(f) for f in fields])
