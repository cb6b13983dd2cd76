"""Spatial joins: labels to segments, boxes to cells and boxes, containment and first matches.

Boxes have x0, y0, x1, y1.  Spark has no range join, so both sides are put into square cells
and joined on them; the exact predicate follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.common import is_finite
from gridloom.functions.wkt import contains, edges_of
from gridloom.operators.raster import map_to_pixel


#: Cells of an outline that are tested, or of several that are returned, at once.
CELLS_AT_ONCE = 500_000
#: Boxes of a side that a task takes at once from one cell, and pairs of boxes it looks at together.
BLOCK_BOXES, PAIRS_AT_ONCE = 2_000, 200_000


def cells(low: Column, high: Column, size: float) -> Column:
    """Numbers of the cells that [low, high] touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def box_join(left: DataFrame, right: DataFrame, size: float, keys: list[str] | None = None, a: str = "", b: str = "r_", how: str = "touch", margin: float = 0.0) -> DataFrame:
    """All pairs of boxes that touch or overlap, each once; columns of the right side get the prefix ``b``.

    Both sides are copied to the cells they touch; a pair is kept only in the cell of the lower
    left corner of its common part.  ``margin`` widens the left boxes.  ``how`` "overlap" wants a
    common area.  ``size`` should be about the size of a large box.
    """
    keys = keys or []
    r = right.select(*[F.col(c).alias(b + c) for c in right.columns])
    x0, x1 = F.col("x0") - margin, F.col("x1") + margin
    y0, y1 = F.col("y0") - margin, F.col("y1") + margin
    lc = left.withColumn("_cx", F.explode(cells(x0, x1, size))).withColumn("_cy", F.explode(cells(y0, y1, size)))
    rc = r.withColumn("_dx", F.explode(cells(F.col(b + "x0"), F.col(b + "x1"), size))).withColumn("_dy", F.explode(cells(F.col(b + "y0"), F.col(b + "y1"), size)))
    on = (F.col("_cx") == F.col("_dx")) & (F.col("_cy") == F.col("_dy"))
    for k in keys:
        on = on & (F.col(k) == F.col(b + k))
    strict = how == "overlap"
    meet = lambda p, q: p < q if strict else p <= q
    exact = meet(x0, F.col(b + "x1")) & meet(F.col(b + "x0"), x1) & meet(y0, F.col(b + "y1")) & meet(F.col(b + "y0"), y1)
    once = (F.col("_cx") == F.floor(F.greatest(x0, F.col(b + "x0")) / size)) & (F.col("_cy") == F.floor(F.greatest(y0, F.col(b + "y0")) / size))
    return lc.join(rc, on).where(exact & once).drop("_cx", "_cy", "_dx", "_dy")


def neighbours(points: DataFrame, radius: float, carry: list[str] = [], keys: list[str] = []) -> DataFrame:
    """id, x, y, other, ox, oy, d of ordered pairs id < other at most ``radius`` apart, by cells of that size.

    ``keys`` (as raster_id), which come first, must be equal.  Both sides are sorted by cell and
    merged: a small file may hold millions of points, so its size is no reason to broadcast it.
    """
    p = points.select(*keys, "id", "x", "y", *carry).withColumn("_cx", F.floor(F.col("x") / radius)).withColumn("_cy", F.floor(F.col("y") / radius))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = p.withColumn("_n", near).withColumn("_cx", F.col("_cx") + F.col("_n.i")).withColumn("_cy", F.col("_cy") + F.col("_n.j")).drop("_n")
    right = p.select(*keys, F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), *[F.col(c).alias(f"o_{c}") for c in carry], "_cx", "_cy")
    d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    return left.join(right.hint("merge"), [*keys, "_cx", "_cy"]).where("id < other").withColumn("d", d).where(F.col("d") <= radius).drop("_cx", "_cy")


def on_map(keys: list[str] = []) -> Column:
    """True for points with finite coordinates and known ``keys``; others have no neighbours."""
    ok = is_finite(F.col("x")) & is_finite(F.col("y"))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return ok


def with_place(points: DataFrame, keys: list[str] = []) -> DataFrame:
    """Points with ``place``: the least id at the same x and y of the same ``keys``; a point off the map is its own place.

    Many seeds may share few places, and most of what holds for a pair of seeds holds for their places.
    """
    at = [*keys, "x", "y"]
    least = points.where(on_map(keys)).groupBy(*at).agg(F.min("id").alias("place"))
    return points.join(least.hint("merge"), at, "left").withColumn("place", F.coalesce("place", "id"))


def links(points: DataFrame, radius: float) -> DataFrame:
    """id, other: edges that connect the same groups of points as ``neighbours`` does, by places instead of points."""
    placed = with_place(points.select("id", "x", "y"))
    far = neighbours(placed.where("id = place"), radius).select("id", "other")
    return placed.where("id <> place").select(F.col("place").alias("id"), F.col("id").alias("other")).unionByName(far)


def distance_counts(points: DataFrame, radius: float) -> DataFrame:
    """d, pairs: how many pairs of points are that far apart, for each distance up to ``radius``; pairs of places are weighted, not listed."""
    places = points.where(on_map()).groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    far = neighbours(places, radius, ["n"]).select("d", (F.col("n") * F.col("o_n")).alias("pairs"))
    here = places.where("n > 1").select(F.lit(0.0).alias("d"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return far.unionByName(here).groupBy("d").agg(F.sum("pairs").alias("pairs"))


def label_segments(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments of one class, mixed segments) from segment_id, class of the points in or on each segment.

    The first has segment_id, feature_class; the second segment_id, n_classes.  Null classes
    do not count.
    """
    g = hits.where("class is not null").groupBy("segment_id").agg(F.count_distinct("class").alias("n_classes"), F.min("class").alias("feature_class"))
    return g.where("n_classes = 1").select("segment_id", "feature_class"), g.where("n_classes > 1").select("segment_id", "n_classes")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Points (id, x, y, ...) in or on boxes."""
    p = points.withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))
    b = boxes.withColumn("_cx", F.explode(cells(F.col("x0"), F.col("x1"), size))).withColumn("_cy", F.explode(cells(F.col("y0"), F.col("y1"), size)))
    return p.join(b, ["_cx", "_cy"]).where("x >= x0 and x <= x1 and y >= y0 and y <= y1").drop("_cx", "_cy")


def within_or_overlapping(segment_px: DataFrame, zone: Column) -> DataFrame:
    """segment_id, relation: "within" if all pixels lie in the zone, "overlaps" if some do; others are left out."""
    g = segment_px.groupBy("segment_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(zone).alias("_in"))
    return g.where("_in > 0").select("segment_id", F.when(F.col("_in") == F.col("_n"), "within").otherwise("overlaps").alias("relation"))


def rasterize_boxes(boxes: DataFrame, height: int, width: int, id_column: str = "segment_id") -> DataFrame:
    """row, col, label: cells whose centre lies in a box on a unit grid; of several boxes the last id wins."""
    first = lambda lo: F.greatest(F.ceil(F.col(lo) - 0.5), F.lit(0)).cast("int")
    last = lambda hi, n: F.least(F.ceil(F.col(hi) - 0.5) - 1, F.lit(n - 1)).cast("int")
    d = boxes.withColumn("_r0", first("y0")).withColumn("_r1", last("y1", height)).withColumn("_c0", first("x0")).withColumn("_c1", last("x1", width)).where("_r0 <= _r1 and _c0 <= _c1")
    d = d.withColumn("row", F.explode(F.sequence("_r0", "_r1"))).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    return d.groupBy("row", "col").agg(F.max(id_column).alias("label"))


def pixels_of_outlines(shapes: DataFrame, cell: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """id, row, col: cells of a square grid whose centre lies in or on an outline (id, outline; see ``near.outlines``).

    Row 0 begins at ``y0`` and rows go up.  Each outline is worked off by itself, in bands of rows
    of bounded size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for i, raw in zip(batch.id, batch.outline):
                o = np.frombuffer(raw).reshape(-1, 2)
                edges, first = edges_of([o])
                (ax, ay), (bx, by) = np.nanmin(o, axis=0), np.nanmax(o, axis=0)
                cols = np.arange(int(np.ceil((ax - x0) / cell - 0.5)), int(np.floor((bx - x0) / cell - 0.5)) + 1)
                rows = np.arange(int(np.ceil((ay - y0) / cell - 0.5)), int(np.floor((by - y0) / cell - 0.5)) + 1)
                step = max(1, CELLS_AT_ONCE // max(1, len(cols)))
                for a in range(0, len(rows) if len(cols) else 0, step):
                    r, c = (v.ravel() for v in np.meshgrid(rows[a : a + step], cols, indexing="ij"))
                    ok = contains(np.zeros(len(r), int), x0 + (c + 0.5) * cell, y0 + (r + 0.5) * cell, edges, first)
                    held.append((np.full(ok.sum(), i), r[ok], c[ok]))
                    size += int(ok.sum())
                    if size > CELLS_AT_ONCE:
                        yield frame(held)
                        held, size = [], 0
        if held:
            yield frame(held)

    def frame(held: list[tuple]) -> pd.DataFrame:
        i, r, c = (np.concatenate(v) for v in zip(*held))
        return pd.DataFrame({"id": i, "row": r.astype("int32"), "col": c.astype("int32")})

    return shapes.select("id", "outline").mapInPandas(run, "id long, row int, col int")


def sample_raster(points: DataFrame, px: DataFrame, gt: tuple[float, ...] = (1, 0, 0, 0, 1, 0), value: str = "v", out: str = "sampled", keys: list[str] = ["raster_id"]) -> DataFrame:
    """Points (id, x, y, raster_id) with the value of the cell of their raster that holds them, by the affine ``gt``.

    Points off the raster or on missing cells are dropped.
    """
    row, col = map_to_pixel(F.col("x"), F.col("y"), gt)
    p = points.withColumn("row", row).withColumn("col", col)
    return p.join(px.select(*keys, "row", "col", F.col(value).alias(out)).where(F.col(out).isNotNull()), [*keys, "row", "col"])


def overlap_area(b: str = "r_") -> Column:
    w = F.least(F.col("x1"), F.col(b + "x1")) - F.greatest(F.col("x0"), F.col(b + "x0"))
    h = F.least(F.col("y1"), F.col(b + "y1")) - F.greatest(F.col("y0"), F.col(b + "y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def shared_border(b: str = "r_") -> Column:
    w = F.least(F.col("x1"), F.col(b + "x1")) - F.greatest(F.col("x0"), F.col(b + "x0"))
    h = F.least(F.col("y1"), F.col(b + "y1")) - F.greatest(F.col("y0"), F.col(b + "y0"))
    return F.when((w == 0) | (h == 0), F.greatest(w, h, F.lit(0.0))).otherwise(F.lit(0.0))


def assign_by_overlap(items: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """Each item (item_id, box) with the ``fid`` of the zone it overlaps most; else of the longest touching border; else null.

    Ties go to the smallest fid.
    """
    best = best_overlaps(items, zones, size).groupBy("item_id").agg(F.max(F.struct("_a", "_t", (-F.col("fid")).alias("f"))).alias("_b"))
    return items.join(best.hint("merge"), "item_id", "left").withColumn("fid", -F.col("_b.f")).withColumn("area", F.coalesce(F.col("_b._a"), F.lit(0.0))).drop("_b")


def best_overlaps(items: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """item_id, _a, _t, fid: in each cell, of the zones that an item meets there, the one of most area, border and least fid.

    Of zones with the same box only the least fid counts.  A cell with many boxes is cut into
    blocks of both sides; pairs are compared in arrays and never listed.
    """
    box = ["x0", "y0", "x1", "y1"]
    spread = lambda df: df.withColumn("_cx", F.explode(cells(F.col("x0"), F.col("x1"), size))).withColumn("_cy", F.explode(cells(F.col("y0"), F.col("y1"), size)))
    left, right = spread(items.select("item_id", *box)), spread(zones.groupBy(*box).agg(F.min("fid").alias("fid")))
    blocks = lambda df, name: df.groupBy("_cx", "_cy").agg(F.ceil(F.count(F.lit(1)) / BLOCK_BOXES).cast("int").alias(name))
    sizes = blocks(left, "_lb").join(blocks(right, "_rb").hint("merge"), ["_cx", "_cy"])
    part = lambda df, key, own, other: df.join(sizes.hint("merge"), ["_cx", "_cy"]).withColumn("_o", F.pmod(F.xxhash64(key), F.col(own))).withColumn("_e", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    l = part(left, "item_id", "_lb", "_rb").select("item_id", *box, "_cx", "_cy", F.col("_o").cast("int").alias("_l"), F.col("_e").cast("int").alias("_r"))
    r = part(right, "fid", "_rb", "_lb").select("fid", *box, "_cx", "_cy", F.col("_e").cast("int").alias("_l"), F.col("_o").cast("int").alias("_r"))

    def run(i: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        z, out = z.sort_values("fid"), []
        p, q, fid = i[box].to_numpy(float), z[box].to_numpy(float).T, z.fid.to_numpy()
        step = max(1, PAIRS_AT_ONCE // max(1, len(fid)))
        for a in range(0, len(p) if len(fid) else 0, step):
            x0, y0, x1, y1 = (v[:, None] for v in p[a : a + step].T)
            w, h = np.minimum(x1, q[2]) - np.maximum(x0, q[0]), np.minimum(y1, q[3]) - np.maximum(y0, q[1])
            meet = (x0 <= q[2]) & (q[0] <= x1) & (y0 <= q[3]) & (q[1] <= y1)
            area = np.where(meet, np.maximum(w, 0) * np.maximum(h, 0), -1.0)
            most = area.max(axis=1)
            border = np.where(area == most[:, None], np.where((w == 0) | (h == 0), np.maximum(np.maximum(w, h), 0), 0.0), -1.0)
            k = border.argmax(axis=1)  # the first, so the least fid
            ok = most >= 0
            out.append(pd.DataFrame({"item_id": i.item_id.to_numpy()[a : a + step][ok], "_a": most[ok], "_t": border[np.arange(len(k)), k][ok], "fid": fid[k][ok]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"item_id": [], "_a": [], "_t": [], "fid": []})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    keys = ["_cx", "_cy", "_l", "_r"]
    return l.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(run, f"item_id {kind(items, 'item_id')}, _a double, _t double, fid {kind(zones, 'fid')}")


def first_region(items: DataFrame, regions: DataFrame, size: float) -> DataFrame:
    """Each item (segment_id, box) with the classes of the first region (least region_id) it intersects; null without one."""
    pairs = box_join(items, regions, size)
    first = pairs.groupBy("segment_id").agg(F.min_by("r_acceptable_classes", "r_region_id").alias("acceptable_classes"))
    return items.join(first, "segment_id", "left")


def overlay_union(regions: DataFrame, always: str = "6") -> DataFrame:
    """Cells (row, col) of class regions with their lists joined by commas in region order; ``always`` is put in front unless present."""
    lists = regions.where("classes is not null").groupBy("row", "col").agg(F.array_sort(F.collect_set(F.struct("region_id", "classes"))).alias("_l"))
    joined = F.concat_ws(",", F.transform("_l", lambda s: s["classes"]))
    return lists.select("row", "col", F.when(joined.contains(always), joined).otherwise(F.concat(F.lit(always + ","), joined)).alias("classes"))


def class_array(csv: Column) -> Column:
    """A comma-separated class list as integers; entries that are no numbers become null."""
    return F.transform(F.split(csv, ","), lambda s: F.trim(s).try_cast("int"))
