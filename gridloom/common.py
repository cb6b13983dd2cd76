"""Table access, checkpointing and current-row selection shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; unset, a temporary one on a single machine only."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def local_path(path: str) -> str:
    """A path for plain file access; ``file:`` is taken off and any other scheme refused, since files there would land on one machine's disk."""
    scheme, mark, rest = path.partition(":")
    if mark and scheme == "file":
        return "/" + rest.lstrip("/")
    if mark and rest.startswith("//"):
        raise ValueError(f"{path}: files are read and written through mounted folders only, not {scheme}://")
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable shared checkpoint folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a table's size, without running anything; enormous where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row for each non-null ``key``: the columns of its row with the greatest ``order``.

    Ties and repeated deliveries are settled by comparing ``order`` and then ``columns``
    themselves, so that the result never depends on the physical order of rows.  A null in
    ``order`` sorts first.  Aggregation combines on the map side; no group is collected.
    """
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(packed).alias("_latest"))
        .select(key, *[F.col(f"_latest.v{i}").alias(c) for i, c in enumerate(columns)])
    )


def is_finite(column: Column) -> Column:
    """True where a double is a number: not null, NaN or infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))


def usable(value: Column, nodata: Column) -> Column:
    """True where ``value`` is a finite number other than its raster's nodata value."""
    return is_finite(value) & (nodata.isNull() | F.isnan(nodata) | (value != nodata))


def ranked(df: DataFrame, keys: list[str], order: Column, ties: list[str], rank: str = "rank", bucket_rows: int = 100_000) -> DataFrame:
    """Adds the row number (from 1) within ``keys`` by the 64-bit hash ``order``, then ``ties``.

    A group is spread over buckets of about ``bucket_rows`` by the leading bits of the hash, as many
    as its counted size asks for: each bucket is numbered by itself and shifted by the sizes of
    the buckets before it.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]

    def match(b: str) -> Column:
        on = F.lit(True) if not b else F.col("_b") == F.col(b)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return on

    drop = [f"_k{i}" for i in range(len(keys))]
    bits = lambda n: F.greatest(F.ceil(F.log2(n / F.lit(float(bucket_rows)))), F.lit(0)).cast("int")
    if keys:
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).select(*named, bits(F.col("_size")).alias("_bits"))
        sized = df.join(groups, match("")).drop(*drop)
    else:
        sized = df.withColumn("_bits", bits(F.lit(float(max(1, df.count())))))
    h = sized.withColumn("_h", order).withColumn("_b", F.expr("if(_bits = 0, 0L, shiftright(_h, 64 - _bits))")).drop("_bits")
    sizes = h.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*named, F.col("_b").alias("_ob"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", *ties)
    return h.withColumn("_r", F.row_number().over(inside)).join(offsets, match("_ob")).withColumn(rank, F.col("_r") + F.col("_before")).drop("_h", "_b", "_r", "_ob", "_before", *drop)


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Adds consecutive numbers in the order of some columns (a total order for a defined result).

    Rows are sorted by ranges, counted by partition and shifted, so no task sorts them all; the
    sorted rows are checkpointed, which fixes the ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_pid").orderBy(*order)
    return placed.withColumn("_r", F.row_number().over(inside)).join(offsets, "_pid").withColumn(name, F.col("_before") + F.col("_r") - 1 + start).drop("_pid", "_r", "_before")
