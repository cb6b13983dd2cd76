"""Seeds of trees: peaks, effective distances, clusters, splits, top k and suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.common import checkpoint
from gridloom.operators.graph import components, survivors
from gridloom.operators.neighbours import gaussian, local_maxima
from gridloom.operators.spatial import neighbours, on_map, with_place


def peaks(px: DataFrame, least: float, min_dist_px: int, sigma: float = 0.0, gt: tuple[float, ...] = (1, 0, 0, 0, 1, 0)) -> DataFrame:
    """raster_id, row, col, x, y, height: local maxima (of the smoothed raster where sigma > 0) at cell centres."""
    smooth = gaussian(px, sigma) if sigma > 0 else px
    a, b, c, d, e, f = map(float, gt)
    top = local_maxima(smooth, min_dist_px, least)
    cx, cy = F.col("col") + 0.5, F.col("row") + 0.5
    return top.select("raster_id", "row", "col", (a * cx + b * cy + c).alias("x"), (d * cx + e * cy + f).alias("y"), F.col("v").alias("height"))


def eps_of(height: Column, scale: float, low: float, high: float) -> Column:
    return F.least(F.greatest(height * scale, F.lit(float(low))), F.lit(float(high)))


def effective_distance(pairs: DataFrame, cost: DataFrame, height: int, width: int, weight: float = 0.5, xy_thresh: float = 0.8, samples: int = 12, nodata_cost: float = 1.0, keys: list[str] = []) -> DataFrame:
    """keys, id, other, d_eff: d (1 + weight * mean cost of ``samples`` inner points of the line).

    Pairs at most ``xy_thresh`` apart, or any with weight 0, keep d; coincident ones have 0.  A
    point takes the nearest cell, clamped to the raster; a missing cost counts ``nodata_cost``.
    ``keys`` (as raster_id) tie pairs to the costs of their own raster.
    """
    far = pairs.where((F.col("d") > xy_thresh) & (F.lit(weight) != 0))
    near = pairs.where(~((F.col("d") > xy_thresh) & (F.lit(weight) != 0))).select(*keys, "id", "other", F.col("d").alias("d_eff"))
    t = F.col("k") / F.lit(float(samples + 1))
    cell = lambda p, q, n: F.least(F.greatest(F.bround(F.col(p) + t * (F.col(q) - F.col(p))), F.lit(0)), F.lit(n - 1)).cast("int")
    steps = far.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(samples)))).select(*keys, "id", "other", "d", cell("y", "oy", height).alias("row"), cell("x", "ox", width).alias("col"))
    mean = steps.join(cost.select(*keys, "row", "col", "cost").hint("merge"), [*keys, "row", "col"], "left").groupBy(*keys, "id", "other").agg(F.max("d").alias("d"), F.avg(F.coalesce("cost", F.lit(float(nodata_cost)))).alias("_c"))
    return mean.select(*keys, "id", "other", (F.col("d") * (1 + weight * F.col("_c"))).alias("d_eff")).unionByName(near)


def place_distances(places: DataFrame, cost: DataFrame, height: int, width: int, radius: float, weight: float = 0.5, xy_thresh: float = 0.8, keys: list[str] = [], both: bool = False) -> DataFrame:
    """keys, id, other, d_eff of places (keys, id, x, y) at most ``radius`` apart; with ``both`` each pair also turned, as the line then takes other cells at ties."""
    pairs = neighbours(places, radius, keys=keys)
    if both:
        turned = pairs.select(*keys, F.col("other").alias("id"), F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "d")
        pairs = pairs.unionByName(turned)
    return effective_distance(pairs, cost, height, width, weight, xy_thresh, keys=keys)


def effective_pairs(seeds: DataFrame, cost: DataFrame, height: int, width: int, radius: float, weight: float = 0.5, xy_thresh: float = 0.8, keys: list[str] = []) -> DataFrame:
    """keys, id, other, d_eff of all pairs id < other at most ``radius`` apart: ``effective_distance`` of ``neighbours``.

    Costs are averaged once for each pair of places and then handed to the seeds that stand there.
    """
    placed = checkpoint(with_place(seeds.where(on_map(keys)).select(*keys, "id", "x", "y"), keys))
    lines = place_distances(placed.where("id = place").drop("place"), cost, height, width, radius, weight, xy_thresh, keys, both=True)
    own = placed.where("id = place").select(*keys, "id", F.col("id").alias("other"), F.lit(0.0).alias("d_eff"))
    lines = lines.unionByName(own).select(*keys, F.col("id").alias("_p"), F.col("other").alias("_q"), "d_eff")
    one, two = placed.select(*keys, F.col("place").alias("_p"), "id"), placed.select(*keys, F.col("place").alias("_q"), F.col("id").alias("other"))
    return lines.join(one.hint("merge"), [*keys, "_p"]).join(two.hint("merge"), [*keys, "_q"]).where("id < other").select(*keys, "id", "other", "d_eff")


def cluster(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds with ``cluster``: 0.. in order of the least id of each connected group."""
    parts = components(seeds, edges.select(F.col("id").alias("a"), F.col("other").alias("b")))
    return seeds.join(parts.hint("merge"), "id").withColumnRenamed("component", "root")


def median_split(seeds: DataFrame, dz: float, key: str = "root") -> DataFrame:
    """``part``: 1 for seeds above the median height of a cluster whose heights span more than dz, else 0."""
    g = seeds.groupBy(key).agg((F.max("height") - F.min("height")).alias("_span"), F.percentile("height", 0.5).alias("_mid"))
    return seeds.join(g, key).withColumn("part", F.when((F.col("_span") > dz) & (F.col("height") > F.col("_mid")), 1).otherwise(0)).drop("_span", "_mid")


def top_k(seeds: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k tallest of each group, ties by id; all with k <= 0."""
    if k <= 0:
        return seeds
    w = Window.partitionBy(*keys).orderBy(F.col("height").desc(), "id")
    return seeds.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def nms_coded(seeds: DataFrame, base: float, scale: float, keys: list[str], max_radius: float) -> DataFrame:
    """A seed survives unless a later one (lower, or equal with a greater id) of its cluster has it within its own radius max(base, scale * height).

    ``max_radius`` bounds all radii and sizes the cells of the join.
    """
    if base <= 0 and scale <= 0:
        return seeds
    left, _ = _outlived(seeds, base, scale, keys, [F.col("height"), F.col("id").desc()])
    by_cell = lambda df: df.withColumn("_cx", F.floor(F.col("x") / max_radius)).withColumn("_cy", F.floor(F.col("y") / max_radius))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = by_cell(left.where(on_map(keys))).withColumn("_n", step).withColumn("_cx", F.col("_cx") + F.col("_n.i")).withColumn("_cy", F.col("_cy") + F.col("_n.j")).alias("a")
    other = by_cell(seeds.where(on_map(keys)).select("id", "x", "y", "height", *keys)).alias("b")
    on = F.lit(True)
    for k in [*keys, "_cx", "_cy"]:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    d = F.sqrt((F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x")) + (F.col("a.y") - F.col("b.y")) * (F.col("a.y") - F.col("b.y")))
    later = (F.col("b.height") < F.col("a.height")) | ((F.col("b.height") == F.col("a.height")) & (F.col("b.id") > F.col("a.id")))
    # the first such seed decides: pairs are not listed
    beaten = near.join(other.hint("merge"), on & later & (d <= F.least(_radius(F.col("b.height"), base, scale), F.lit(float(max_radius)))), "left_semi").select("id")
    return left.join(beaten.distinct().hint("merge"), "id", "left_anti")


def _radius(height: Column, base: float, scale: float) -> Column:
    return F.greatest(F.lit(float(base)), height * scale)


def _outlived(seeds: DataFrame, base: float, scale: float, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Seeds of which one at the most is left of each place, and the ids of the others.

    Of seeds of one place and group the first by ``order`` has all others within its radius, so
    no other survives; those off the map or without a height or radius are all left.
    """
    w = Window.partitionBy(*keys, "x", "y").orderBy(*order)
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    able = on_map(keys) & F.col("height").isNotNull()
    ranked = seeds.where(able).withColumn("_r", F.row_number().over(w)).withColumn("_top", _radius(first("height"), base, scale))
    gone = (F.col("_r") > 1) & (F.col("_top") >= 0)
    return ranked.where(~gone).drop("_r", "_top").unionByName(seeds.where(~able)), ranked.where(gone).select("id")


def nms_greedy(seeds: DataFrame, base: float, scale: float, key: str, max_radius: float) -> DataFrame:
    """The tallest seed of a cluster removes those within its radius, then the next tallest that is left, and so on.

    Ties go to the smaller id.  ``max_radius`` bounds all radii and sizes the cells of the join.
    """
    if base <= 0 and scale <= 0:
        return seeds
    left, _ = _outlived(seeds, base, scale, [key], [F.col("height").desc(), F.col("id")])
    close = neighbours(left, max_radius, ["height"], [key])
    first = F.col("height") >= F.col("o_height")  # pairs have id < other
    winner, loser = F.when(first, F.col("id")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("id"))
    radius = F.greatest(F.lit(float(base)), F.greatest("height", "o_height") * scale)
    return survivors(left, close.where(F.col("d") <= radius).select(winner.alias("winner"), loser.alias("loser")))


def ball_clusters(seeds: DataFrame, eps_scale: float = 0.4, min_eps: float = 2, max_eps: float = 8, z_thresh: float = -1, min_samples: int = 2) -> DataFrame:
    """``cluster1``: greedy balls in id order; a ball of enough seeds takes them all, also those taken before; null without one.

    A seed opens a ball unless an earlier ball took it.  Which balls are large and flat enough is
    known beforehand, so the order is a greedy suppression by id, and a seed belongs to the last
    ball that holds it.  Numbers are the id of the seed whose ball it was.
    """
    cell = lambda c: F.floor(F.col(c) / max_eps)
    placed = checkpoint(with_place(seeds.select("id", "x", "y", "height")))
    towns = placed.groupBy("place").agg(F.first("x").alias("ox"), F.first("y").alias("oy"), F.count(F.lit(1)).alias("_n"), F.max("height").alias("_hi"), F.min("height").alias("_lo"))
    # seeds of one place and radius have one ball, and the first that fits takes the place
    balls = placed.groupBy("place", "x", "y", eps_of(F.col("height"), eps_scale, min_eps, max_eps).alias("_eps")).agg(F.min("id").alias("id"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = balls.where(on_map()).withColumn("_s", step).withColumn("_cx", cell("x") + F.col("_s.i")).withColumn("_cy", cell("y") + F.col("_s.j"))
    there = towns.withColumnRenamed("place", "other").withColumn("_cx", cell("ox")).withColumn("_cy", cell("oy"))
    d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    columns = ["id", "place", "other", "_n", "_hi", "_lo"]
    held = near.join(there.hint("merge"), ["_cx", "_cy"]).where(d <= F.least("_eps", F.lit(float(max_eps)))).select(*columns)
    alone = balls.where(~on_map() & (F.col("_eps") >= 0)).select("id", "place", F.col("place").alias("other")).join(towns.hint("merge"), "place").select(*columns)
    held = checkpoint(held.unionByName(alone))
    fits = held.groupBy("id", "place").agg(F.sum("_n").alias("_n"), (F.max("_hi") - F.min("_lo")).alias("_span")).where(F.col("_n") >= min_samples)
    if z_thresh >= 0:
        fits = fits.where(F.col("_span") <= z_thresh)
    openers = checkpoint(fits.groupBy("place").agg(F.min("id").alias("id")))
    opened = held.select("id", "other").join(openers.select("id"), "id")
    beaten = opened.join(openers.select(F.col("place").alias("other"), F.col("id").alias("loser")), "other").where("loser > id")
    centres = survivors(openers.select("id"), beaten.select(F.col("id").alias("winner"), "loser"))
    last = opened.join(centres, "id").groupBy(F.col("other").alias("place")).agg(F.max("id").alias("cluster1"))
    named = placed.select("id", "place").join(last, "place").select(F.col("id").alias("_o"), "cluster1")
    return seeds.join(named, F.col("id") == F.col("_o"), "left").drop("_o")


def canonical_seeds(chm: DataFrame, density: DataFrame, cost: DataFrame, height: int, width: int, merge_radius: float = 1.5, cost_weight: float = 0.5, xy_thresh: float = 0.8, dz_merge: float = 0, max_per_cluster: int = 0, nms_base: float = 0, nms_scale: float = 0, keys: list[str] = []) -> DataFrame:
    """Both detectors' seeds (id, x, y, height) merged: clusters of effective distance, split, trimmed, suppressed.

    Since the effective distance is never below the plain one, only pairs within
    ``merge_radius`` are looked at, and only those of the same ``keys`` (as raster_id).
    """
    seeds = chm.withColumn("origin", F.lit("chm")).unionByName(density.withColumn("origin", F.lit("density")))
    placed = checkpoint(with_place(seeds.select(*keys, "id", "x", "y"), keys))
    d = place_distances(placed.where("id = place").drop("place"), cost, height, width, merge_radius, cost_weight, xy_thresh, keys, both=True).where(F.col("d_eff") <= merge_radius)
    # a line is drawn from the lesser id, so it takes a greater one at its other end
    greatest = placed.groupBy(F.col("place").alias("other")).agg(F.max("id").alias("_top"))
    far = d.select("id", "other").join(greatest.hint("merge"), "other").where("id < _top").select("id", "other")
    here = placed.where("id <> place").select(F.col("place").alias("id"), F.col("id").alias("other"))
    grouped = cluster(seeds, far.unionByName(here))
    grouped = median_split(grouped, dz_merge) if dz_merge > 0 else grouped.withColumn("part", F.lit(0))
    kept = top_k(grouped, max_per_cluster, ["root", "part"])
    if nms_base > 0 or nms_scale > 0:
        tallest = kept.agg(F.max("height")).first()[0] or 0.0  # one number: the bound of all radii
        kept = nms_coded(kept, nms_base, nms_scale, ["root", "part"], max(nms_base, nms_scale * tallest, 1e-9))
    return kept.withColumn("cluster", F.col("root") * 2 + F.col("part")).drop("root", "part")
