"""Detection data: boxes, tiles, annotations, suppression and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.common import checkpoint, numbered
from gridloom.operators.graph import FINISH_EDGES, survivors
from gridloom.operators.spatial import BLOCK_BOXES, PAIRS_AT_ONCE, box_join, cells


def iou(b: str = "r_") -> Column:
    """Intersection over union of a box and the prefixed box; 1e-6 in the denominator."""
    area = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    w = F.greatest(F.least(F.col("x1"), F.col(b + "x1")) - F.greatest(F.col("x0"), F.col(b + "x0")), F.lit(0.0))
    h = F.greatest(F.least(F.col("y1"), F.col(b + "y1")) - F.greatest(F.col("y0"), F.col(b + "y0")), F.lit(0.0))
    return w * h / (area("") + area(b) - w * h + 1e-6)


def iou_pairs(boxes: DataFrame, size: float, least: float = 0.0, carry: list[str] = []) -> DataFrame:
    """box_id < r_box_id of one image with their ``iou`` above ``least`` and the columns ``carry`` of both; boxes without a common area are no pair.

    Boxes go to the cells they touch, and a pair comes out in the cell of the lower left corner of
    its common part.  In a cell each box meets only those that begin within its width; a cell
    with many boxes is cut into blocks, and each two blocks are a task.
    """
    box, at = ["x0", "y0", "x1", "y1"], ["image_id", "_cx", "_cy"]
    spread = boxes.select("box_id", "image_id", *box, *carry).withColumn("_cx", F.explode(cells(F.col("x0"), F.col("x1"), size))).withColumn("_cy", F.explode(cells(F.col("y0"), F.col("y1"), size)))
    sizes = spread.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK_BOXES).cast("int").alias("_n"))
    own = spread.join(sizes.hint("merge"), at).withColumn("_b", F.pmod(F.xxhash64("box_id"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    own = own.withColumn("_l", F.least("_b", "_o")).withColumn("_r", F.greatest("_b", "_o")).drop("_n", "_o")
    names = [*(n for c in ("box_id", *carry) for n in (c, f"r_{c}")), "iou"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("x0")
        x0, y0, x1, y1 = g[box].to_numpy(float).T
        ids, block, cx, cy, two = g.box_id.to_numpy(), g["_b"].to_numpy(), g["_cx"].iloc[0], g["_cy"].iloc[0], g["_l"].iloc[0] != g["_r"].iloc[0]
        n = np.maximum(np.searchsorted(x0, x1) - np.arange(1, len(g) + 1), 0)  # boxes that begin before the end of each
        ends, found, a = np.cumsum(n), [], 0
        while a < len(g):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE)))
            m = n[a:b]
            i = np.repeat(np.arange(a, min(b, len(g))), m)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            a = b
            keep = (y0[i] < y1[j]) & (y0[j] < y1[i]) & (x0[i] < x1[j]) & (ids[i] != ids[j])
            if two:
                keep &= block[i] != block[j]
            i, j = i[keep], j[keep]
            left, low = np.maximum(x0[i], x0[j]), np.maximum(y0[i], y0[j])
            w, h = np.minimum(x1[i], x1[j]) - left, np.minimum(y1[i], y1[j]) - low
            share = np.maximum(w, 0) * np.maximum(h, 0)
            value = share / ((x1[i] - x0[i]) * (y1[i] - y0[i]) + (x1[j] - x0[j]) * (y1[j] - y0[j]) - share + 1e-6)
            keep = (np.floor(left / size) == cx) & (np.floor(low / size) == cy) & (value > least)
            i, j, value = i[keep], j[keep], value[keep]
            i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
            found.append((i, j, value))
        i, j, value = (np.concatenate(v) for v in zip(*found))
        return pd.DataFrame({n: v for c in ("box_id", *carry) for n, v in ((c, g[c].to_numpy()[i]), (f"r_{c}", g[c].to_numpy()[j]))} | {"iou": value})[names]

    kind = {f.name: f.dataType.simpleString() for f in boxes.schema}
    schema = ", ".join(f"{n} {'double' if n == 'iou' else kind[n.removeprefix('r_')]}" for n in names)
    return own.groupBy(*at, "_l", "_r").applyInPandas(run, schema)


def box_nms(boxes: DataFrame, size: float, threshold: float = 0.5) -> DataFrame:
    """Greedy suppression in each image: best score first, then least box_id; ``size`` is about that of a large box."""
    first = F.col("score") >= F.col("r_score")  # pairs have box_id < r_box_id
    ends = [F.when(first, F.col("box_id")).otherwise(F.col("r_box_id")).alias("winner"), F.when(first, F.col("r_box_id")).otherwise(F.col("box_id")).alias("loser")]
    left, kept = checkpoint(boxes.select("box_id", "image_id", "x0", "y0", "x1", "y1", "score")), None
    while True:
        edges = iou_pairs(left, size, threshold, ["score"]).select(*ends)
        beaten = checkpoint(edges.groupBy("loser").agg(F.count(F.lit(1)).alias("n")))
        if (beaten.agg(F.sum("n")).first()[0] or 0) <= FINISH_EDGES:
            last = survivors(left.select(F.col("box_id").alias("id")), edges)
            break
        # edges are too many to keep: boxes that none beats stay, those they beat go, and the rest is paired again
        marked = left.join(beaten.select(F.col("loser").alias("box_id"), F.lit(True).alias("_d")).hint("merge"), "box_id", "left").withColumn("_d", F.coalesce("_d", F.lit(False)))
        marked = checkpoint(marked)
        free = iou_pairs(marked, size, threshold, ["score", "_d"]).select(*ends, F.when(first, F.col("_d")).otherwise(F.col("r__d")).alias("_d")).where("not _d")
        top = marked.where("not _d").select(F.col("box_id").alias("id"))
        kept = top if kept is None else kept.unionByName(top)
        left = checkpoint(marked.where("_d").drop("_d").join(free.select(F.col("loser").alias("box_id")).distinct().hint("merge"), "box_id", "left_anti"))
    kept = last if kept is None else kept.unionByName(last)
    return boxes.join(kept.select(F.col("id").alias("box_id")).hint("merge"), "box_id", "left_semi")


def clamp_boxes(boxes: DataFrame, row0: Column, col0: Column, height: Column, width: Column) -> DataFrame:
    """Pixel boxes moved into a window and clamped to it; degenerate ones are dropped."""
    x = lambda c: F.least(F.greatest(F.col(c) - col0, F.lit(0)), width - 1)
    y = lambda c: F.least(F.greatest(F.col(c) - row0, F.lit(0)), height - 1)
    moved = boxes.select(*[c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")], x("x0").alias("x0"), y("y0").alias("y0"), x("x1").alias("x1"), y("y1").alias("y1"))
    return moved.where("x0 < x1 and y0 < y1")


def tile_annotations(tiles: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Annotations of each tile (tile_no, box) that contains at least one box whole: box_id in tile pixels, label 1."""
    inside = box_join(boxes, tiles, size).where("x0 >= r_x0 and x1 <= r_x1 and y0 >= r_y0 and y1 <= r_y1")
    moved = inside.withColumn("tile_no", F.col("r_tile_no")).withColumn("label", F.lit(1))
    return moved.select("tile_no", "box_id", "label", *[F.col(c).alias(c) for c in ("x0", "y0", "x1", "y1", "r_x0", "r_y0", "r_x1", "r_y1")])


def annotations_json(boxes: DataFrame) -> DataFrame:
    """tile_no, image, json: {"file_name", "boxes", "labels"} of each tile from tile_no, box_id, x0, y0, x1, y1, label."""
    rows = F.array_sort(F.collect_list(F.struct("box_id", F.array("x0", "y0", "x1", "y1").alias("b"), "label")))
    g = boxes.groupBy("tile_no").agg(rows.alias("_r"))
    name = F.format_string("img_%03d", F.col("tile_no"))
    body = F.struct(F.concat(name, F.lit(".jpg")).alias("file_name"), F.transform("_r", lambda s: s["b"]).alias("boxes"), F.transform("_r", lambda s: s["label"]).alias("labels"))
    return g.select("tile_no", name.alias("image"), F.to_json(body).alias("json"))


def transforms_json(tiles: DataFrame, gt: tuple, crs: str, keys: list[str] = []) -> DataFrame:
    """keys, tile_no, tile_name, json: {"transform": [a..f], "crs"} of each tile window (tile_no, row0, col0); the affine may be columns."""
    a, b, c, d, e, f = (v if isinstance(v, Column) else F.lit(float(v)) for v in gt)
    t = F.array(a, b, a * F.col("col0") + b * F.col("row0") + c, d, e, d * F.col("col0") + e * F.col("row0") + f)
    return tiles.select(*keys, "tile_no", F.format_string("img_%03d.jpg", F.col("tile_no")).alias("tile_name"), F.to_json(F.struct(t.alias("transform"), F.lit(crs).alias("crs"))).alias("json"))


def box_polygons(boxes: DataFrame) -> DataFrame:
    """Map boxes (minx, miny, maxx, maxy) with their outline as WKT in ``geometry``."""
    corner = lambda x, y: F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    ring = F.concat_ws(", ", *[corner(x, y) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])
    return boxes.withColumn("geometry", F.concat(F.lit("POLYGON (("), ring, F.lit("))")))


def included(features: DataFrame, column: str = "include") -> DataFrame:
    """Features whose mark begins with "yes"; null excludes, and without such a column all stay."""
    return features.where(F.col(column).startswith("yes")) if column in features.columns else features


def mean_losses(losses: DataFrame) -> DataFrame:
    """epoch, loss: mean over the batches of each epoch."""
    return losses.groupBy("epoch").agg(F.avg("loss").alias("loss"))


def detection_samples(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, pixels scaled to 0..255, target: images with the list of their boxes; images without a box are left out."""
    low, high = F.array_min("pixels"), F.array_max("pixels")
    scaled = F.transform("pixels", lambda v: ((v - low) / (high - low + 1e-8) * 255).cast("int"))
    target = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_id", "x0", "y0", "x1", "y1"))).alias("target"))
    return images.select("image_id", scaled.alias("pixels")).join(target, "image_id")


def explode_annotations(df: DataFrame, column: str) -> DataFrame:
    """image, file_name, box_no, x0, y0, x1, y1, label of a JSON map image -> annotation; entries without boxes vanish."""
    kind = "map<string, struct<file_name string, boxes array<array<double>>, labels array<int>>>"
    m = df.select(F.explode(F.from_json(column, kind)).alias("image", "a")).select("image", "a.file_name", F.posexplode(F.arrays_zip("a.boxes", "a.labels")).alias("box_no", "z"))
    return m.select("image", "file_name", "box_no", *[F.get("z.boxes", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.col("z.labels").alias("label"))


def georeference(predictions: DataFrame, transforms: DataFrame) -> DataFrame:
    """Pixel boxes of tiles as map boxes by each tile's affine [a, b, c, d, e, f]; label "Tree" and null score by default.

    Predictions of unknown tiles are dropped.
    """
    j = predictions.join(transforms, "tile_name")
    t = [F.get("transform", F.lit(i)) for i in range(6)]
    x = lambda c, r: t[0] * F.col(c) + t[1] * F.col(r) + t[2]
    y = lambda c, r: t[3] * F.col(c) + t[4] * F.col(r) + t[5]
    xs, ys = (x("x0", "y0"), x("x1", "y1")), (y("x0", "y0"), y("x1", "y1"))
    label = F.coalesce("label", F.lit("Tree")) if "label" in predictions.columns else F.lit("Tree")
    score = F.col("score") if "score" in predictions.columns else F.lit(None).cast("double")
    return j.select("tile_name", "box_id", F.least(*xs).alias("minx"), F.least(*ys).alias("miny"), F.greatest(*xs).alias("maxx"), F.greatest(*ys).alias("maxy"), label.alias("label"), score.alias("score"), "crs")


def augment(boxes: DataFrame, seed: int, train: bool = True, p: float = 0.5) -> DataFrame:
    """Boxes with random quarter turns and flips of their image (image_id, width, height); none in validation.

    The choice depends on image_id and the seed alone, so the pixels can follow it:
    ``rotated`` (a quarter turn against the clock, done first) and ``flipped`` (left to right).
    """
    draw = lambda salt: F.pmod(F.xxhash64("image_id", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) < int(p * 1_000_000)
    d = boxes.withColumn("rotated", draw(1) if train else F.lit(False)).withColumn("flipped", draw(2) if train else F.lit(False))
    rot = F.col("rotated")
    d = d.select("*", F.when(rot, F.col("y0")).otherwise(F.col("x0")).alias("_a0"), F.when(rot, F.col("y1")).otherwise(F.col("x1")).alias("_a1"), F.when(rot, F.col("width") - F.col("x1")).otherwise(F.col("y0")).alias("_b0"), F.when(rot, F.col("width") - F.col("x0")).otherwise(F.col("y1")).alias("_b1"), F.when(rot, F.col("height")).otherwise(F.col("width")).alias("_w"), F.when(rot, F.col("width")).otherwise(F.col("height")).alias("_h"))
    f = F.col("flipped")
    keep = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1", "width", "height")]
    return d.select(*keep, "rotated", "flipped", F.when(f, F.col("_w") - F.col("_a1")).otherwise(F.col("_a0")).alias("x0"), F.col("_b0").alias("y0"), F.when(f, F.col("_w") - F.col("_a0")).otherwise(F.col("_a1")).alias("x1"), F.col("_b1").alias("y1"), F.col("_w").alias("width"), F.col("_h").alias("height"))


def collate(samples: DataFrame, batch: int) -> DataFrame:
    """Batches of ``batch`` images in hash order: batch_no, images and targets as parallel lists."""
    from pyspark.sql.window import Window

    numbered = samples.withColumn("_b", F.pmod(F.xxhash64("image_id"), F.lit(64)))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("image_id")) - 1
    return numbered.withColumn("_n", F.floor(rank / batch)).groupBy("_b", "_n").agg(F.sort_array(F.collect_list(F.struct("image_id", "target"))).alias("_s")).select(F.col("_s.image_id").alias("images"), F.col("_s.target").alias("targets"))


def predict(images: DataFrame, model: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float = 0.5, keys: list[str] = ["image_id"]) -> DataFrame:
    """keys, x0, y0, x1, y1, score, label from a user's model.

    ``images``: keys, height, width, bands, pixels (array<double>, row by row, bands last).
    Values are scaled by the image's minimum and maximum to 0..1 before the model sees (bands, h, w).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                a = np.asarray(r.pixels, float).reshape(r.height, r.width, r.bands)
                a = (a - a.min()) / (a.max() - a.min() + 1e-8) if a.size else a
                boxes, scores, labels = model(np.moveaxis(a, -1, 0))
                out += [(*(getattr(r, c) for c in keys), *map(float, b), float(s), int(k)) for b, s, k in zip(boxes, scores, labels) if s >= threshold]
            yield pd.DataFrame(out, columns=[*keys, "x0", "y0", "x1", "y1", "score", "label"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keys).schema)
    return images.mapInPandas(run, names + ", x0 double, y0 double, x1 double, y1 double, score double, label int")


def patch_arrays(px: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """raster_id, row0, col0, height, width, bands, pixels: overlapping square patches of a long relation with ``band``.

    Patches step by ``size - overlap`` from the upper left; pixels are row by row, bands last, and
    cells without a value are 0.  A patch is bounded by its size.
    """
    step = size - overlap
    if step < 1 or overlap < 0:
        raise ValueError("the overlap must be at least 0 and less than the size")
    reach = lambda c: F.sequence(F.expr(f"int(greatest({c} - {size} + {step}, 0) div {step})"), F.expr(f"int({c} div {step})"))
    whole = px.groupBy("raster_id").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"), (F.max("band") + 1).alias("bands"))
    d = px.select("raster_id", "row", "col", "band", F.col("v").cast("double").alias("v")).withColumn("_pr", F.explode(reach("row"))).withColumn("_pc", F.explode(reach("col")))
    d = d.where(f"row < _pr * {step} + {size} and col < _pc * {step} + {size}").join(whole, "raster_id").withColumn("row0", F.col("_pr") * step).withColumn("col0", F.col("_pc") * step)
    d = d.withColumn("height", F.least(F.lit(size), F.col("_h") - F.col("row0"))).withColumn("width", F.least(F.lit(size), F.col("_w") - F.col("col0")))
    at = ((F.col("row") - F.col("row0")) * F.col("width") + F.col("col") - F.col("col0")) * F.col("bands") + F.col("band")
    keys = ["raster_id", "row0", "col0", "height", "width", "bands"]
    cells = F.collect_list(F.struct(at.cast("int").alias("k"), "v"))
    g = d.where("v is not null").groupBy(*keys).agg(cells.alias("_c"))

    @F.pandas_udf("array<double>")
    def filled(k: pd.Series, v: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for places, values, n in zip(k, v, size):
            a = np.zeros(n)
            a[places] = values
            out.append(a)
        return pd.Series(out)

    return g.select(*keys, filled(F.col("_c.k"), F.col("_c.v"), F.col("height") * F.col("width") * F.col("bands")).alias("pixels"))


def predict_patches(px: DataFrame, model: Callable, size: int, overlap: int, threshold: float = 0.5, nms: float = 0.15) -> DataFrame:
    """raster_id, x0, y0, x1, y1, score, label in raster pixels: a model run over overlapping patches, doubles suppressed across them."""
    patches = patch_arrays(px, size, overlap)
    found = predict(patches.select("raster_id", "row0", "col0", "height", "width", "bands", "pixels"), model, threshold, ["raster_id", "row0", "col0"])
    fields = [F.col("raster_id").alias("image_id"), *[(F.col(c) + F.col("col0" if c[0] == "x" else "row0")).alias(c) for c in ("x0", "y0", "x1", "y1")], "score", "label"]
    boxes = numbered(found.select(*fields).distinct(), ["image_id", "x0", "y0", "x1", "y1", "score", "label"], "box_id")
    return box_nms(boxes, float(size), nms).withColumnRenamed("image_id", "raster_id").drop("box_id")
