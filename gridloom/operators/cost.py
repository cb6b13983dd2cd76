"""Cost surfaces from an eight-band image, a canopy height model and segment labels."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.common import checkpoint
from gridloom.operators.neighbours import entropy, label_edges, sobel
from gridloom.operators.raster import ndvi, percentile_normalise


def cost_surface(image: DataFrame, chm: DataFrame, labels: DataFrame | None = None, weights: tuple[float, float, float, float] = (0.5, 0.25, 0.25, 0.0)) -> DataFrame:
    """raster_id, row, col, cost in 0..1: gradient of heights, gaps in vegetation, texture and segment edges, weighted.

    ``image``: raster_id, row, col, b0..b7; ``chm``: v; ``labels``: label.  All on one grid.
    Without labels the other three weights are scaled up.  Missing parts count 0, as each part is
    normalised with missing values at 0.  The texture, the dearest, is checkpointed for its percentiles.
    """
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError(f"the four weights add up to {sum(weights)}, not to 1")
    if labels is None:  # the part without data goes, and the others grow to a sum of 1 again
        warnings.warn("no labels: the cost has three terms only", stacklevel=2)
        kept = sum(weights[:3])
        weights = (*(w / kept for w in weights[:3]), 0.0)
    at = ["raster_id", "row", "col"]
    parts = percentile_normalise(sobel(chm.select(*at, "v")), value="gradient", out="grad").select(*at, "grad")
    bands = percentile_normalise(image.withColumn("_g", 1 - ndvi(F.col("b4"), F.col("b6"))), value="_g", out="gap")
    bands = percentile_normalise(bands, value="b0", out="_n").withColumn("_p", (F.col("_n") * 255).cast("int")).select(*at, "gap", "_p")
    texture_px = percentile_normalise(checkpoint(entropy(bands, value="_p")), value="entropy", out="tex").select(*at, "tex")
    j = bands.select(*at, "gap").join(texture_px, at).join(parts, at)
    if labels is not None:
        j = j.join(percentile_normalise(label_edges(labels), value="edge", out="border").select(*at, "border"), at)
    else:
        j = j.withColumn("border", F.lit(0.0))
    total = sum((w * F.col(part) for w, part in zip(weights, ("grad", "gap", "tex", "border"))), F.lit(0.0))
    return j.select(*at, F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)).alias("cost"))
