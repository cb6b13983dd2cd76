from pyspark.sql import functions as F

from gridloom.streaming.tiles import TILE_SCHEMA, read_tiles, running_means


def test_tiles_arrive_in_order(spark, tmp_path):
    folder = str(tmp_path / "tiles")
    df = spark.range(20).select(F.lit(1).cast("long").alias("raster_id"), (F.col("id") % 2).alias("segment_id"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.col("id").cast("double").alias("v"), F.timestamp_seconds(F.lit(1_600_000_000)).alias("arrived_at"))
    spark.createDataFrame(df.collect(), TILE_SCHEMA).write.parquet(folder)
    q = running_means(read_tiles(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("means").start()
    try:
        q.processAllAvailable()
        assert {(r.segment_id, r.n, r["mean"]) for r in spark.sql("select * from means").collect()} == {(0, 10, 9.0), (1, 10, 10.0)}
    finally:
        q.stop()
