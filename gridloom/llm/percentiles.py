"""Percentiles of very large columns by cumulative frequencies (problem 2).

Data are reduced to (group, value, count) summaries.  Summaries of separate partitions, days
or portions are combined by adding counts, so nothing but the summary has to be kept.  For
percentiles the summary is range-sorted, every range partition is numbered by a running sum,
partition offsets are added, and the first values whose cumulative count reaches the wanted
ranks are picked.

Error bound: 0 for ``resolution=None``; otherwise values are rounded to multiples of
``resolution`` and every percentile is within ``resolution / 2`` of the exact one (rounding
is monotone, and so is interpolation between neighbouring ranks).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.common import checkpoint, is_finite


def summarise(df: DataFrame, groups: list[str], value: str, resolution: float | None = None) -> DataFrame:
    """The mergeable summary: groups, ``value``, ``cnt``.

    Nulls, NaN and infinities in the value are left out; a null group is a group of its own.
    Group columns named value, cnt, pct, n or result are refused.
    """
    if {"value", "cnt", "pct", "n", "result"} & set(groups):
        raise ValueError("a group column bears the name of a result column")
    v = F.col(value).cast("double")
    kept = df.where(is_finite(v)).withColumn("value", (v if resolution is None else F.round(v / resolution) * resolution) + F.lit(0.0))
    return kept.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("cnt"))


def merge(summaries: list[DataFrame], groups: list[str]) -> DataFrame:
    """One summary for the union of the data behind ``summaries``."""
    return reduce(DataFrame.unionByName, summaries).groupBy(*groups, "value").agg(F.sum("cnt").alias("cnt"))


def percentiles(summary: DataFrame, groups: list[str], pcts: list[int], partitions: int | None = None) -> DataFrame:
    """groups, ``pct``, ``n``, ``result``: percentiles with linear interpolation.

    One group may hold any share of the rows: its values are spread over range partitions.
    The sorted summary is checkpointed, so that range boundaries are drawn once.  Groups
    without values do not appear.
    """
    n = partitions or int(summary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*groups, "value", "cnt"]
    placed = checkpoint(summary.select(*cols).repartitionByRange(n, *groups, "value").withColumn("_pid", F.spark_partition_id()))
    totals = placed.groupBy(*groups, "_pid").agg(F.sum("cnt").alias("_t"))
    by_group = Window.partitionBy(*groups)
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_pid").alias("_p"),
        (F.sum("_t").over(by_group.orderBy("_pid")) - F.col("_t")).alias("_before"),
        F.sum("_t").over(by_group).alias("n"),
    )
    on = F.col("_pid") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    running = Window.partitionBy(*groups, "_pid").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = placed.withColumn("_run", F.sum("cnt").over(running)).join(offsets, on).withColumn("_to", F.col("_before") + F.col("_run")).withColumn("_from", F.col("_to") - F.col("cnt"))

    def position(p: int) -> Column:
        return (F.col("n") - 1) * F.lit(p) / F.lit(100.0)

    def covers(rank: Column) -> Column:
        return (F.col("_from") < rank) & (F.col("_to") >= rank)

    low = {p: F.floor(position(p)) + 1 for p in pcts}
    high = {p: F.least(F.floor(position(p)) + 2, F.col("n")) for p in pcts}
    hits = cumulated.where(reduce(lambda a, b: a | b, [covers(r) for p in pcts for r in (low[p], high[p])]))
    picked = hits.groupBy(*groups).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(covers(low[p]), F.col("value"))).alias(f"_l{p}") for p in pcts],
        *[F.max(F.when(covers(high[p]), F.col("value"))).alias(f"_h{p}") for p in pcts],
    )
    stacked = F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.col(f"_l{p}").alias("lo"), F.col(f"_h{p}").alias("hi"), (position(p) - F.floor(position(p))).alias("w")) for p in pcts]))
    return picked.withColumn("_s", stacked).select(*groups, "_s.pct", "n", (F.col("_s.lo") + (F.col("_s.hi") - F.col("_s.lo")) * F.col("_s.w")).alias("result"))
