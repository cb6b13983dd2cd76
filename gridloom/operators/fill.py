"""Missing values filled from similar records, by hierarchical group statistics (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accuracy of the median sketch; a group of at most this many values gets its exact lower median.
MEDIAN_ACCURACY = 10_000


def fill_missing(df: DataFrame, fields: dict[str, str], levels: list[tuple[list[str], int]]) -> DataFrame:
    """Fills the null entries of ``fields`` and marks them.

    ``fields`` maps a column to ``"median"`` (numeric) or ``"mode"`` (any type).  ``levels`` go
    from the finest to the coarsest group: (group columns, least number of known values).
    A missing value takes the statistic of the finest group with enough support.  The result
    has all columns of ``df`` and, for each field f, ``f_filled`` (true where a value was filled
    in) and ``f_level`` (0 for the finest; null where nothing was filled).  A value that no
    level can fill stays null with ``f_filled`` false.  A null in a group column means the
    record has no group at that level.  NaN must be turned into null by the caller.  Columns of
    ``df`` that bear the name of a mark are replaced by it.

    The lower median comes from a mergeable sketch of bounded size, and the mode from value
    counts (most frequent, then smallest), so a group of any size is combined on the map side.
    The statistics are joined back by their group; adaptive execution splits a hot group.
    """
    names = {f: f"_fill{i}" for i, f in enumerate(fields)}
    out = df
    for n, (group, support) in enumerate(levels):
        keyed = df
        for c in group:
            keyed = keyed.where(F.col(c).isNotNull())
        stats = None
        medians = [f for f, kind in fields.items() if kind == "median"]
        if medians:
            stats = keyed.groupBy(*group).agg(*[F.when(F.count(f) >= support, F.percentile_approx(f, 0.5, MEDIAN_ACCURACY)).alias(f"{names[f]}_{n}") for f in medians])
        for f in (f for f, kind in fields.items() if kind == "mode"):
            counts = keyed.where(F.col(f).isNotNull()).groupBy(*group, f).agg(F.count(F.lit(1)).alias("_n"))
            best = counts.groupBy(*group).agg(F.sum("_n").alias("_all"), F.min(F.struct((-F.col("_n")).alias("n"), F.col(f).alias("v"))).alias("_best"))
            mode = best.select(*group, F.when(F.col("_all") >= support, F.col("_best.v")).alias(f"{names[f]}_{n}"))
            stats = mode if stats is None else stats.join(mode, group, "full")
        on = None
        for i, c in enumerate(group):
            stats = stats.withColumnRenamed(c, f"_g{n}_{i}")
            term = out[c] == stats[f"_g{n}_{i}"]
            on = term if on is None else on & term
        out = out.join(stats, on, "left").drop(*[f"_g{n}_{i}" for i in range(len(group))])
    done = []
    marks = {f"{f}_{m}" for f in fields for m in ("filled", "level")}
    for c in (c for c in df.columns if c not in marks):
        done.append(F.coalesce(F.col(c), *[F.col(f"{names[c]}_{n}") for n in range(len(levels))]).alias(c) if c in fields else F.col(c))
    for f in fields:
        level = F.lit(None).cast("int")
        for n in reversed(range(len(levels))):
            level = F.when(F.col(f"{names[f]}_{n}").isNotNull(), n).otherwise(level)
        level = F.when(F.col(f).isNull(), level)
        done += [level.isNotNull().alias(f"{f}_filled"), level.alias(f"{f}_level")]
    return out.select(*done)


def filled_values(filled: DataFrame, key: str, fields: list[str], what: str = "filled") -> DataFrame:
    """key, ``field_name``, ``value``, ``level``: the values filled in, or with ``what="left"`` those left missing."""
    entry = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("double").alias("value"), F.col(f"{f}_level").alias("level"), F.col(f"{f}_filled").alias("filled")) for f in fields]))
    rows = filled.select(key, entry.alias("_e")).select(key, "_e.*")
    return rows.where("filled" if what == "filled" else "not filled and value is null").drop("filled")
