"""Segmentation: superpixels, quick shift, connected regions, outlines and checkerboard tiling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.common import checkpoint
from gridloom.operators.graph import components
from gridloom.operators.neighbours import TILE, tile_kernel
from gridloom.operators.raster import tile_keys


def slic(px: DataFrame, bands: list[str], n_segments: int, compactness: float = 10.0, iterations: int = 10) -> DataFrame:
    """raster_id, row, col, label: superpixels by k-means in value and place (Achanta et al., 2012).

    Centres start on a grid of step S.  In each round every centre is copied to the 3 x 3 grid
    cells around its own, pixels meet the centres of their cell, and the nearest wins; a pixel
    that meets none keeps its label, at first that of its own cell.  New centres are map-side
    means.  Pixels outside a mask are simply absent, and pixels with a null band get no label.
    Labels are centre numbers; ``enforce_connectivity`` cuts them into connected regions.
    """
    if n_segments < 1:
        raise ValueError("n_segments must be at least 1")
    ok = px.select("raster_id", "row", "col", *[F.col(b).cast("double").alias(b) for b in bands])
    for b in bands:
        ok = ok.where(F.col(b).isNotNull())
    step = ok.groupBy("raster_id").agg(F.greatest(F.sqrt(F.count(F.lit(1)) / n_segments), F.lit(1.0)).alias("_s"))
    grid = lambda c: F.floor(F.col(c) / F.col("_s")).cast("int")
    ok = ok.join(step, "raster_id").withColumn("_gr", grid("row")).withColumn("_gc", grid("col"))
    labelled = checkpoint(ok.withColumn("label", F.col("_gr").cast("long") * 1_000_003 + F.col("_gc")))
    mean = [F.avg("row").alias("_r"), F.avg("col").alias("_c"), F.max("_s").alias("_s"), *[F.avg(b).alias(f"_m_{b}") for b in bands]]
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for _ in range(iterations):
        centres = labelled.groupBy("raster_id", "label").agg(*mean)
        around = centres.withColumn("_n", near).select("raster_id", F.col("label").alias("_l"), "_r", "_c", *[f"_m_{b}" for b in bands], (F.floor(F.col("_r") / F.col("_s")) + F.col("_n.i")).cast("int").alias("_gr"), (F.floor(F.col("_c") / F.col("_s")) + F.col("_n.j")).cast("int").alias("_gc"))
        place = (F.pow(F.col("row") - F.col("_r"), 2) + F.pow(F.col("col") - F.col("_c"), 2)) * (compactness * compactness) / (F.col("_s") * F.col("_s"))
        colour = sum((F.pow(F.col(b) - F.col(f"_m_{b}"), 2) for b in bands), F.lit(0.0))
        met = F.when(F.col("_l").isNotNull(), F.struct((colour + place).alias("d"), F.col("_l").alias("label")))
        best = labelled.join(around, ["raster_id", "_gr", "_gc"], "left").groupBy("raster_id", "row", "col", "_s", "_gr", "_gc", *bands).agg(F.min(met).alias("_b"), F.max("label").alias("_l"))
        # each round is read twice, for its centres and for the labels to keep
        labelled = checkpoint(best.withColumn("label", F.coalesce("_b.label", "_l")).drop("_b", "_l"))
    return labelled.select("raster_id", "row", "col", "label")


def slic_array(a: np.ndarray, n_segments: int, compactness: float = 10.0, iterations: int = 10) -> np.ndarray:
    """Superpixel labels (0.., -1 where a band is NaN) of one tile, a (bands, h, w) array."""
    valid = ~np.isnan(a).any(axis=0)
    labels = np.full(a.shape[1:], -1, dtype=np.int64)
    rows, cols = np.nonzero(valid)
    if not len(rows) or n_segments < 1:
        return labels
    step = max(1.0, math.sqrt(len(rows) / n_segments))
    values = a[:, rows, cols].T
    cell = (rows // step).astype(np.int64) * 1_000_003 + (cols // step).astype(np.int64)
    _, own = np.unique(cell, return_inverse=True)
    for _ in range(iterations):
        k = own.max() + 1
        n = np.maximum(np.bincount(own, minlength=k), 1)
        mean = lambda x: np.bincount(own, x, k) / n  # noqa: E731, B023
        cr, cc, cv = mean(rows), mean(cols), np.stack([mean(v) for v in values.T], axis=1)
        best, dist = own.copy(), np.full(len(rows), np.inf)
        order = np.argsort(rows, kind="stable")
        sorted_rows = rows[order]
        for i in range(k):
            lo, hi = np.searchsorted(sorted_rows, [cr[i] - 1.5 * step, cr[i] + 1.5 * step])
            at = order[lo:hi]
            at = at[np.abs(cols[at] - cc[i]) <= 1.5 * step]
            d = ((values[at] - cv[i]) ** 2).sum(axis=1) + ((rows[at] - cr[i]) ** 2 + (cols[at] - cc[i]) ** 2) * (compactness / step) ** 2
            win = d < dist[at]
            best[at[win]], dist[at[win]] = i, d[win]
        _, own = np.unique(best, return_inverse=True)
    labels[rows, cols] = own
    return labels


def quickshift(px: DataFrame, bands: list[str], kernel_size: float = 5.0, max_dist: float = 10.0, ratio: float = 1.0) -> DataFrame:
    """raster_id, row, col, label: each pixel linked to the nearest one of higher density within max_dist (Vedaldi and Soatto, 2008).

    Density and links are dense kernels on tiles; trees of links become labels by connected
    components: the least pixel number of the tree within its raster.  Ties in density go to the pixel
    that comes first by row and column.
    """
    reach = int(math.ceil(3 * kernel_size))

    def density(a: np.ndarray) -> np.ndarray:
        h, w = a.shape[1] - 2 * reach, a.shape[2] - 2 * reach
        mid = a[:, reach : reach + h, reach : reach + w] * ratio
        total = np.zeros((h, w))
        for r in range(-reach, reach + 1):
            for c in range(-reach, reach + 1):
                other = a[:, reach + r : reach + r + h, reach + c : reach + c + w] * ratio
                d = ((mid - other) ** 2).sum(axis=0) + r * r + c * c
                total += np.nan_to_num(np.exp(-d / (2 * kernel_size**2)))
        return total

    link_reach = int(math.floor(max_dist))
    side = 2 * link_reach + 1

    def link(a: np.ndarray) -> np.ndarray:
        h, w = a.shape[1] - 2 * link_reach, a.shape[2] - 2 * link_reach
        mid = a[:, link_reach : link_reach + h, link_reach : link_reach + w]
        best, to = np.full((h, w), np.inf), np.full((h, w), np.nan)
        for r in range(-link_reach, link_reach + 1):
            for c in range(-link_reach, link_reach + 1):
                o = a[:, link_reach + r : link_reach + r + h, link_reach + c : link_reach + c + w]
                d = ((mid[1:] - o[1:]) ** 2).sum(axis=0) * ratio**2 + r * r + c * c
                higher = (o[0] > mid[0]) | ((o[0] == mid[0]) & ((r, c) < (0, 0)))
                take = higher & (d <= max_dist**2) & (d < best)
                best[take], to[take] = d[take], (r + link_reach) * side + c + link_reach
        return to

    width = px.groupBy("raster_id").agg((F.max("col") + 1).alias("_w"))
    d = checkpoint(tile_kernel(px, reach, density, mode="nan", value=bands, out="density"))
    links = tile_kernel(d.join(px.select("raster_id", "row", "col", *bands), ["raster_id", "row", "col"]), link_reach, link, mode="nan", value=["density", *bands], out="to")
    code = F.col("to").cast("int")
    own = F.col("row").cast("long") * F.col("_w") + F.col("col")
    up = (F.col("row") + (code / side).cast("int") - link_reach).cast("long") * F.col("_w") + F.col("col") + F.pmod(code, F.lit(side)) - link_reach
    parent = checkpoint(links.join(width, "raster_id").select("raster_id", "row", "col", own.alias("id"), F.when(F.col("to").isNotNull(), up).alias("up")))
    roots = components(parent.select("raster_id", "id"), parent.select("raster_id", F.col("id").alias("a"), F.col("up").alias("b")), keys=["raster_id"])
    return parent.join(roots, ["raster_id", "id"]).select("raster_id", "row", "col", F.col("component").alias("label"))


def _local_regions(label: np.ndarray) -> np.ndarray:
    """For each cell the flat number of the first cell of its 4-connected region; NaN stays NaN."""
    h, w = label.shape
    ids = np.arange(h * w).reshape(h, w)
    right, down = label[:, 1:] == label[:, :-1], label[1:] == label[:-1]
    a = np.concatenate([ids[:, :-1][right], ids[:-1][down]])
    b = np.concatenate([ids[:, 1:][right], ids[1:][down]])
    own = np.arange(h * w)
    while len(a):
        low = np.minimum(own[a], own[b])
        before = own.copy()
        np.minimum.at(own, own[a], low)
        np.minimum.at(own, own[b], low)
        while ((jump := own[own]) != own).any():
            own = jump
        if (own == before).all():
            break
    return np.where(np.isnan(label), np.nan, own.reshape(h, w))


def connected_regions(labels: DataFrame, label: str = "label", tile: int = TILE) -> DataFrame:
    """raster_id, row, col, label, region: 4-connected pieces of equal label; region is the least pixel number of the piece within its raster.

    Pieces are found inside tiles; only the pieces and the label-equal pixel pairs on tile seams
    enter the graph step.
    """
    codes = labels.select("raster_id", "row", "col", F.col(label).cast("long").alias("label"))
    # dense small codes keep 64-bit labels exact in the kernel's doubles
    coded = codes.join(codes.groupBy("raster_id").agg((F.max("col") + 1).alias("_w")), "raster_id").withColumn("_hi", F.shiftright("label", 32).cast("double")).withColumn("_lo", F.col("label").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("double"))

    def kernel(a: np.ndarray) -> np.ndarray:
        _, inverse = np.unique(np.stack([a[0].ravel(), a[1].ravel()]), axis=1, return_inverse=True)
        flat = np.where(np.isnan(a[0]), np.nan, inverse.reshape(a.shape[1:]))
        return _local_regions(flat)

    local = tile_kernel(coded, 0, kernel, value=["_hi", "_lo"], out="_o", tile=tile)
    size = codes.groupBy("raster_id").agg((F.max("col") + 1).alias("_w"))
    j = local.join(size, "raster_id").join(codes, ["raster_id", "row", "col"])
    tr, tc = F.expr(f"int(row div {tile})"), F.expr(f"int(col div {tile})")
    tw = F.least(F.lit(tile), F.col("_w") - tc * tile)
    first = (tr * tile + F.floor(F.col("_o") / tw)).cast("long") * F.col("_w") + tc * tile + F.pmod(F.col("_o").cast("long"), tw.cast("long"))
    pieces = checkpoint(j.select("raster_id", "row", "col", "label", first.cast("long").alias("piece")))
    down = pieces.where(F.pmod(F.col("row") + 1, F.lit(tile)) == 0).select("raster_id", (F.col("row") + 1).alias("row"), "col", "label", F.col("piece").alias("b"))
    right = pieces.where(F.pmod(F.col("col") + 1, F.lit(tile)) == 0).select("raster_id", "row", (F.col("col") + 1).alias("col"), "label", F.col("piece").alias("b"))
    seams = pieces.join(down.unionByName(right), ["raster_id", "row", "col", "label"]).select("raster_id", F.col("piece").alias("a"), "b").distinct()
    merged = components(pieces.select("raster_id", F.col("piece").alias("id")), seams, keys=["raster_id"])
    return pieces.join(merged.select("raster_id", F.col("id").alias("piece"), F.col("component").alias("region")), ["raster_id", "piece"]).select("raster_id", "row", "col", "label", "region")


def label_counts(labels: DataFrame, label: str = "label") -> DataFrame:
    """raster_id, the distinct labels of each raster, pixels."""
    return labels.where(F.col(label).isNotNull()).groupBy("raster_id", label).agg(F.count(F.lit(1)).alias("pixels"))


def merge_small(regions: DataFrame, least: int) -> DataFrame:
    """raster_id, row, col, region: regions of fewer than ``least`` pixels joined to a neighbour.

    A small region goes to the neighbour with the most pixels (then the least number).  Small ones
    that point at each other end in one region, and two large ones never do.  This is repeated
    until no small region has a neighbour.
    """
    current = checkpoint(regions.select("raster_id", "row", "col", "region"))
    while True:
        sizes = checkpoint(current.groupBy("raster_id", "region").agg(F.count(F.lit(1)).alias("n")))
        small = sizes.where(F.col("n") < least).select("raster_id", "region")
        if small.limit(1).count() == 0:
            return current
        steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
        around = current.join(small, ["raster_id", "region"]).withColumn("_s", steps).select("raster_id", "region", (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"))
        met = around.join(current.select("raster_id", "row", "col", F.col("region").alias("b")), ["raster_id", "row", "col"]).where("b <> region").select("raster_id", "region", "b").distinct()
        to = met.join(sizes.select("raster_id", F.col("region").alias("b"), "n"), ["raster_id", "b"]).groupBy("raster_id", F.col("region").alias("a")).agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
        to = checkpoint(to)
        if to.limit(1).count() == 0:
            return current
        merged = components(sizes.select("raster_id", F.col("region").alias("id")), to, keys=["raster_id"]).select("raster_id", F.col("id").alias("region"), "component")
        current = checkpoint(current.join(merged, ["raster_id", "region"]).select("raster_id", "row", "col", F.col("component").alias("region")))


def enforce_connectivity(labels: DataFrame, least: int) -> DataFrame:
    """raster_id, row, col, region: labels cut into connected regions, those below ``least`` pixels merged into neighbours."""
    return merge_small(connected_regions(labels), least)


def outlines_wkt(regions: DataFrame, gt: tuple[float, ...] = (1, 0, 0, 0, 1, 0)) -> DataFrame:
    """raster_id, region, geometry: each region's outline as WKT, rings along pixel edges, holes included.

    Only the edges between a region and its surroundings are gathered by region.
    """
    p = regions.select("raster_id", "row", "col", "region")
    sides = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(k).alias("k")) for k, (dr, dc) in enumerate(((-1, 0), (0, 1), (1, 0), (0, -1)))]))
    around = p.withColumn("_s", sides).select("raster_id", "region", "row", "col", "_s.k", (F.col("row") + F.col("_s.dr")).alias("_r"), (F.col("col") + F.col("_s.dc")).alias("_c"))
    other = p.select("raster_id", F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("region").alias("_o"))
    edges = around.join(other, ["raster_id", "_r", "_c"], "left").where("_o is null or _o <> region").select("raster_id", "region", "row", "col", "k")
    a, b, c, d, e, f = map(float, gt)

    # each side runs clockwise (in row-down view): from its start corner to its end corner
    start = {0: (0, 0), 1: (0, 1), 2: (1, 1), 3: (1, 0)}
    step = {0: (0, 1), 1: (1, 0), 2: (0, -1), 3: (-1, 0)}

    def trace(sides: Iterator[tuple[int, int, int]]) -> str:
        out: dict[tuple[int, int], list[int]] = {}
        for r, q, k in sides:
            out.setdefault((r + start[k][0], q + start[k][1]), []).append(k)
        rings, corners = [], sorted(out, reverse=True)
        while out:
            at = corners.pop()
            if at not in out:
                continue
            first, k, ring = at, out[at][0], []
            while True:
                ways = out[at]
                # at a corner shared by two pixels turn right, which keeps pieces 4-connected
                k = next((t for t in ((k + 1) % 4, k, (k + 3) % 4) if t in ways), ways[0])
                ways.remove(k)
                if not ways:
                    del out[at]
                if not ring or ring[-1][1] != k:
                    ring.append((at, k))
                at = (at[0] + step[k][0], at[1] + step[k][1])
                if at == first:
                    break
            if first in out:
                corners.append(first)
            points = [p for p, _ in ring]
            rings.append(points + points[:1])
        return "POLYGON (" + ", ".join("(" + ", ".join(f"{a * q + b * r + c:.10g} {d * q + e * r + f:.10g}" for r, q in ring) + ")" for ring in rings) + ")"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # sides of a region may go on in the next batch
        for batch in batches:
            df = batch if held is None else pd.concat([held, batch], ignore_index=True)
            raster, region = df.raster_id.to_numpy(), df.region.to_numpy()
            cuts = np.flatnonzero(np.r_[True, (raster[1:] != raster[:-1]) | (region[1:] != region[:-1])]) if len(df) else np.zeros(0, int)
            if len(cuts) > 1:
                yield whole(df.iloc[: cuts[-1]], cuts)
                df = df.iloc[cuts[-1] :]
            held = df
        if held is not None and len(held):
            yield whole(held, np.zeros(1, int))

    def whole(df: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        cuts = cuts[cuts < len(df)]
        sides = list(zip(df.row.tolist(), df.col.tolist(), df.k.tolist()))
        texts = [trace(sides[x:y]) for x, y in zip(cuts, np.r_[cuts[1:], len(df)])]
        return pd.DataFrame({"raster_id": df.raster_id.to_numpy()[cuts], "region": df.region.to_numpy()[cuts], "geometry": texts})

    placed = edges.repartition("raster_id", "region").sortWithinPartitions("raster_id", "region", "row", "col", "k")
    return placed.mapInPandas(run, "raster_id long, region long, geometry string")


def _segment_tile(bands: list[str], area: float | None, n_segments: int | None, compactness: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf.row.min()), int(pdf.col.min())
        a = np.full((len(bands), int(pdf.row.max()) - r0 + 1, int(pdf.col.max()) - c0 + 1), np.nan)
        rows, cols = pdf.row.to_numpy() - r0, pdf.col.to_numpy() - c0
        a[:, rows, cols] = pdf[bands].to_numpy(float).T
        n = n_segments or max(1, round(len(pdf) / area))
        labels = slic_array(a, n, compactness)[rows, cols]
        keep = labels >= 0
        tile = int(pdf.tile_row.iloc[0]) * 100_000 + int(pdf.tile_col.iloc[0])
        return pd.DataFrame({"raster_id": pdf.raster_id, "row": pdf.row, "col": pdf.col, "segment_id": tile * 1_000_000 + labels})[keep]

    return run


def tiled_segments(px: DataFrame, bands: list[str], tile: int = 200, buffer: int = 30, crown_radius: float = 5.0, pixel_area: float = 1.0, n_segments: int | None = None, compactness: float = 10.0, corner: int | None = None) -> DataFrame:
    """raster_id, row, col, segment_id: superpixels on a checkerboard of tiles.

    Black tiles are segmented at once.  White tiles follow, first those of even tile rows and
    then those of odd ones (the white tiles of one pass are far enough apart to be independent
    when ``2 * buffer <= tile``).  The zone of a white tile is its window widened by ``buffer``
    less two corner squares at its lower end; segments wholly inside are replaced, segments that
    cross its edge keep their pixels, and the rest of the zone is segmented anew.  Without a
    mask all pixels count; pixels outside a mask are absent.
    """
    if 2 * buffer > tile:
        raise ValueError("the buffer must be at most half a tile")
    corner = buffer // 2 if corner is None else corner
    area = math.pi * crown_radius**2 / pixel_area
    work = _segment_tile(bands, area, n_segments, compactness)
    schema = "raster_id long, row int, col int, segment_id long"
    base = tile_keys(px.select("raster_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *bands), tile)
    done = checkpoint(base.where("not white").groupBy("raster_id", "tile_row", "tile_col").applyInPandas(work, schema).withColumn("segment_id", F.col("segment_id") * 4))
    for turn in (0, 1):
        reach = lambda c: F.sequence(F.expr(f"int(greatest({c} - {buffer}, 0) div {tile})"), F.expr(f"int(({c} + {buffer}) div {tile})"))
        zone = px.select("raster_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *bands).withColumn("tile_row", F.explode(reach("row"))).withColumn("tile_col", F.explode(reach("col")))
        zone = zone.where((F.pmod(F.col("tile_row") + F.col("tile_col"), F.lit(2)) == 1) & (F.pmod(F.col("tile_row"), F.lit(2)) == turn))
        bottom = F.col("row") >= (F.col("tile_row") + 1) * tile + buffer - corner
        left = F.col("col") < F.col("tile_col") * tile - buffer + corner
        right = F.col("col") >= (F.col("tile_col") + 1) * tile + buffer - corner
        zone = zone.where(~(bottom & (left | right)))
        held = zone.select("raster_id", "row", "col", "tile_row", "tile_col").join(done, ["raster_id", "row", "col"])
        inside = held.groupBy("raster_id", "segment_id", "tile_row", "tile_col").agg(F.count(F.lit(1)).alias("_in"))
        whole = done.groupBy("raster_id", "segment_id").agg(F.count(F.lit(1)).alias("_n"))
        state = checkpoint(inside.join(whole, ["raster_id", "segment_id"]))
        gone = state.where("_in = _n").select("raster_id", "segment_id").distinct()
        crossing = held.join(state.where("_in < _n").select("raster_id", "segment_id", "tile_row", "tile_col"), ["raster_id", "segment_id", "tile_row", "tile_col"]).select("raster_id", "row", "col", "tile_row", "tile_col")
        free = zone.join(crossing, ["raster_id", "row", "col", "tile_row", "tile_col"], "left_anti")
        # windows of one pass may only meet at their corners; the first tile takes such a pixel
        new = free.groupBy("raster_id", "tile_row", "tile_col").applyInPandas(work, schema).groupBy("raster_id", "row", "col").agg(F.min("segment_id").alias("segment_id")).withColumn("segment_id", F.col("segment_id") * 4 + 1 + turn)
        kept = done.join(gone, ["raster_id", "segment_id"], "left_anti")
        done = checkpoint(kept.join(new.select("raster_id", "row", "col"), ["raster_id", "row", "col"], "left_anti").select("raster_id", "row", "col", "segment_id").unionByName(new.select("raster_id", "row", "col", "segment_id")))
    return done
