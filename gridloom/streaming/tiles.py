"""Tiles that arrive in a folder: an optional streaming source for the zonal operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE_SCHEMA = "raster_id long, segment_id long, row int, col int, v double, arrived_at timestamp"


def read_tiles(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Pixels of Parquet tiles as they appear in a shared folder."""
    return spark.readStream.schema(TILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_means(pixels: DataFrame, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """raster_id, segment_id, window, n, mean over windows of arrival; rows later than ``delay`` are dropped."""
    return pixels.withWatermark("arrived_at", delay).groupBy("raster_id", "segment_id", F.window("arrived_at", window)).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
