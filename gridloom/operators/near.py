"""Complete radius joins by Voronoi partition and vantage-point trees (problem 5).

Pivots drawn from the indexed points, in proportion to their number, split the plane (or sphere)
into Voronoi cells in two levels: about the square root of them are heads, and every other pivot
belongs to its nearest head.  An indexed point lives with its nearest head, in the cell of the
nearest of that head's pivots.  By the triangle inequality a query with radius r can only meet
points of heads, and below a head of pivots, that are at most ``d(nearest) + 2 r`` away, so it is
copied to just those.  In a cell the points form a vantage-point tree under the exact metric,
walked by all queries of the cell at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.common import checkpoint
from gridloom.functions.wkt import contains, edges_of, parse_outlines

#: Points wanted in a cell, and the most rows of either side in one task.
CELL_POINTS, BLOCK_ROWS = 4_000, 20_000
#: Most pivots, for four billion points; they are 16 bytes each on the driver and in the tasks.  Beyond, cells grow.
MAX_PIVOTS = 1 << 20
#: Cells up to which their table of blocks (12 bytes each) is broadcast; more are joined.
BROADCAST_CELLS = 100_000
#: Limits include equality; decimal coordinates are doubles, so distances this much over it (metres) count as equal.
SLACK = 1e-9
EARTH_RADIUS_M = 6_371_008.8


def euclidean(ax, ay, bx, by):
    return np.hypot(ax - bx, ay - by)


def great_circle(ax, ay, bx, by):
    """Metres between (longitude, latitude) pairs in degrees, by the haversine formula."""
    ax, ay, bx, by = (np.radians(v) for v in (ax, ay, bx, by))
    h = np.sin((by - ay) / 2) ** 2 + np.cos(ay) * np.cos(by) * np.sin((bx - ax) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


METRICS = {"euclidean": euclidean, "great_circle": great_circle}


class VantageTree:
    """Points split at the median distance from a vantage point, down to small leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: Callable, leaf: int = 40) -> None:
        self.x, self.y, self.metric = x, y, metric
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []  # (low, high, vantage or -1, inner max, outer min, inner node, outer node)
        if len(x):
            self._build(0, len(x), leaf)

    def _build(self, low: int, high: int, leaf: int) -> int:
        at = len(self.nodes)
        if high - low <= leaf:
            self.nodes.append((low, high, -1, 0.0, 0.0, -1, -1))
            return at
        self.nodes.append(())
        vantage, rest = self.order[low], self.order[low + 1 : high]
        d = self.metric(self.x[vantage], self.y[vantage], self.x[rest], self.y[rest])
        half = len(rest) // 2
        by = np.argpartition(d, half)
        self.order[low + 1 : high] = rest[by]
        d = d[by]
        mid = low + 1 + half
        inner, outer = self._build(low + 1, mid, leaf), self._build(mid, high, leaf)
        self.nodes[at] = (low, high, int(vantage), float(d[:half].max()), float(d[half:].min()), inner, outer)
        return at

    def within(self, qx: np.ndarray, qy: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, point number, distance) of all pairs at most r apart."""
        found: list[tuple] = []
        stack = [(0, np.arange(len(qx)))] if self.nodes and len(qx) else []
        while stack:
            at, q = stack.pop()
            low, high, vantage, inner_max, outer_min, inner, outer = self.nodes[at]
            if vantage < 0:
                own = self.order[low:high]
                for a in range(0, len(q), 50_000):
                    part = q[a : a + 50_000]
                    d = self.metric(qx[part, None], qy[part, None], self.x[None, own], self.y[None, own])
                    i, j = np.nonzero(d <= r[part, None])
                    if len(i):
                        found.append((part[i], own[j], d[i, j]))
                continue
            d = self.metric(qx[q], qy[q], self.x[vantage], self.y[vantage])
            hit = d <= r[q]
            if hit.any():
                found.append((q[hit], np.full(hit.sum(), vantage), d[hit]))
            if len(go := q[d - r[q] <= inner_max]):
                stack.append((inner, go))
            if len(go := q[d + r[q] >= outer_min]):
                stack.append((outer, go))
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return tuple(np.concatenate(part) for part in zip(*found))


class Pivots:
    """Heads and the pivots below them; cells are numbered head by head."""

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: Callable) -> None:
        self.metric = metric
        n = max(1, round(math.sqrt(len(x))))
        self.head_x, self.head_y = x[:n], y[:n]
        own = np.concatenate([self._distances(x[a : a + 4096], y[a : a + 4096]).argmin(axis=1) for a in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        self.x, self.y = x[order], y[order]
        self.first = np.searchsorted(own[order], np.arange(n + 1))

    def _distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.metric(x[:, None], y[:, None], self.head_x[None], self.head_y[None])

    def cells(self, x: np.ndarray, y: np.ndarray, r: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of points, one for each, or with ``r`` of queries, one for each cell they may meet."""
        # 1e-6 keeps the bound safe against rounding of the distances
        reach = lambda d, radius: d <= d.min(axis=1, keepdims=True) + 2 * radius[:, None] + 1e-6
        d = self._distances(x, y)
        if r is None:
            row, head = np.arange(len(x)), d.argmin(axis=1)
        else:
            row, head = np.nonzero(reach(d, r))
        order = np.argsort(head, kind="stable")
        row, head = row[order], head[order]
        rows, cells = [], []
        cuts = np.flatnonzero(np.r_[True, head[1:] != head[:-1], True]) if len(head) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            low, high = self.first[head[a]], self.first[head[a] + 1]
            step = max(1, 1_000_000 // (high - low))
            for c in range(a, b, step):
                part = row[c : min(b, c + step)]
                below = self.metric(x[part, None], y[part, None], self.x[None, low:high], self.y[None, low:high])
                i, j = (np.arange(len(part)), below.argmin(axis=1)) if r is None else np.nonzero(reach(below, r[part]))
                rows.append(part[i])
                cells.append(low + j)
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _pivots(points: DataFrame, metric: Callable) -> Pivots:
    """One pivot for ``CELL_POINTS`` points: the places whose hash is below a bound, so copies of a place are one."""
    count = points.count()
    n = int(min(MAX_PIVOTS, count // CELL_POINTS))
    share = int(2.0**63 * min(1.0, n / max(1, count)))
    place = F.xxhash64("x", "y").bitwiseAND(F.lit((1 << 63) - 1))
    drawn = points.select("x", "y", place.alias("h")).where(F.col("h") < F.lit(share)).distinct().toPandas().sort_values(["h", "x", "y"])
    return Pivots(drawn.x.to_numpy(float), drawn.y.to_numpy(float), metric) if len(drawn) else Pivots(np.zeros(1), np.zeros(1), metric)


def _assigner(shared, copies: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = shared.value
        step = max(1, 1_000_000 // len(pivots.head_x))
        for batch in batches:
            for a in range(0, len(batch), step):
                part = batch.iloc[a : a + step]
                row, cell = pivots.cells(part.x.to_numpy(), part.y.to_numpy(), part.r.to_numpy() if copies else None)
                yield part.iloc[row].assign(cell=cell.astype("int32"))

    return run


_OK = "x is not null and y is not null and not isnan(x) and not isnan(y) and id is not null"


def radius_join(queries: DataFrame, points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """left_id, right_id, distance of all pairs of a query and a point at most the query's ``r`` apart.

    ``queries``: id, x, y, r; ``points``: id, x, y.  Rows with null or NaN in x, y or r, or a
    negative r, match nothing; repeated rows give one pair.
    """
    q = queries.select("id", "x", "y", "r").where(_OK + " and r >= 0 and not isnan(r)").distinct()
    return _join(q, _distinct(points), metric)


def _distinct(points: DataFrame) -> DataFrame:
    return checkpoint(points.select("id", "x", "y").where(_OK).distinct())


def _join(queries: DataFrame, points: DataFrame, metric: str, refine: bool = False, ordered: bool = False) -> DataFrame:
    """The join of distinct rows.  With ``refine`` queries have an ``outline`` that must hold the point; ``ordered`` keeps left_id < right_id.

    Pairs come out once, since a point has one cell.  A cell with many rows (dense area, or many
    copies of one place) is cut into blocks of both sides; each pair of blocks is a task of its
    own, so no task holds more than 2 BLOCK_ROWS.
    """
    d = METRICS[metric]
    pivots = points.sparkSession.sparkContext.broadcast(_pivots(points, d))
    fields = "id long, x double, y double"
    right = checkpoint(points.mapInPandas(_assigner(pivots, False), f"{fields}, cell int"))
    left = checkpoint(queries.mapInPandas(_assigner(pivots, True), f"{fields}, r double{', outline binary' * refine}, cell int"))
    # Blocks of each cell, joined back as a table; a cell of many blocks is one place with many copies, or a rare dense one.
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
    sizes = blocks(left, "lb").join(blocks(right, "rb"), "cell")
    if len(pivots.value.x) <= BROADCAST_CELLS:
        sizes = F.broadcast(sizes)
    left = left.join(sizes, "cell").withColumn("l", F.pmod(F.xxhash64("id"), F.col("lb")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("rb") - 1))).drop("lb", "rb")
    right = right.join(sizes, "cell").withColumn("b", F.pmod(F.xxhash64("id"), F.col("rb")).cast("int")).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("lb") - 1))).drop("lb", "rb")

    def local(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        px, py = p.x.to_numpy(), p.y.to_numpy()
        i, j, dist = VantageTree(px, py, d).within(q.x.to_numpy(), q.y.to_numpy(), q.r.to_numpy() + SLACK)
        lid, rid = q.id.to_numpy(), p.id.to_numpy()
        if ordered:
            keep = lid[i] < rid[j]
            i, j, dist = i[keep], j[keep], dist[keep]
        if refine and len(i):
            used, own = np.unique(i, return_inverse=True)
            raw = q.outline.to_numpy()
            edges, first = edges_of([np.frombuffer(raw[k]).reshape(-1, 2) for k in used])
            keep = contains(own, px[j], py[j], edges, first)
            i, j, dist = i[keep], j[keep], dist[keep]
        return pd.DataFrame({"left_id": lid[i], "right_id": rid[j], "distance": dist})

    keys = ["cell", "l", "b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(local, "left_id long, right_id long, distance double")


def outlines(df: DataFrame, id_column: str, geometry: str) -> DataFrame:
    """id, x, y, r, outline: each outline with the middle and half the diagonal of its bounds.

    Geometries without coordinates are left out, as are null ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shapes = parse_outlines(batch.geometry.tolist())
            kept = [k for k, o in enumerate(shapes) if o is not None]
            if not kept:
                continue
            own = [shapes[k] for k in kept]
            points = np.concatenate(own)
            starts = np.r_[0, np.cumsum([len(o) for o in own])[:-1]]
            low, high = np.fmin.reduceat(points, starts, axis=0), np.fmax.reduceat(points, starts, axis=0)
            mid, half = (low + high) / 2, np.hypot(*(high - low).T) / 2 + 1e-6
            yield pd.DataFrame({"id": batch.id.to_numpy()[kept], "x": mid[:, 0], "y": mid[:, 1], "r": half, "outline": [o.tobytes() for o in own]})

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(geometry).alias("geometry")).where("id is not null and geometry is not null").distinct()
    return rows.mapInPandas(run, "id long, x double, y double, r double, outline binary")


def _ring_signs(rings: list[np.ndarray]) -> np.ndarray:
    """1 for rings that bound area and -1 for holes: by how many other rings surround the middle of a ring's first side."""
    if len(rings) == 1:
        return np.ones(1)
    edges, first = edges_of(rings)
    mid = np.array([(r[0] + r[1]) / 2 for r in rings])
    i, j = np.nonzero(~np.eye(len(rings), dtype=bool))
    inside = contains(i, mid[j, 0], mid[j, 1], edges, first)
    return 1.0 - 2 * (np.bincount(j, inside, len(rings)) % 2)


def outline_measures(shapes: DataFrame) -> DataFrame:
    """id, area, perimeter, minx, miny, maxx, maxy of outlines (see ``outlines``); holes count against the area."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, raw in zip(batch.id, batch.outline):
                o = np.frombuffer(raw).reshape(-1, 2)
                rings = [r for r in np.split(o, np.flatnonzero(np.isnan(o[:, 0]))) if len(r)]
                rings = [r[1:] if np.isnan(r[0, 0]) else r for r in rings]
                base = rings[0][0]
                area = [abs(((r[:-1] - base)[:, 0] * (r[1:] - base)[:, 1] - (r[1:] - base)[:, 0] * (r[:-1] - base)[:, 1]).sum()) / 2 for r in rings]
                length = sum(np.hypot(*np.diff(r, axis=0).T).sum() for r in rings)
                out.append((i, float(np.dot(area, _ring_signs(rings))), float(length), *np.nanmin(o, axis=0).tolist(), *np.nanmax(o, axis=0).tolist()))
            yield pd.DataFrame(out, columns=["id", "area", "perimeter", "minx", "miny", "maxx", "maxy"])

    return shapes.select("id", "outline").mapInPandas(run, "id long, area double, perimeter double, minx double, miny double, maxx double, maxy double")


def points_in_outlines(points: DataFrame, segments: DataFrame) -> DataFrame:
    """point_id, segment_id: points (id, x, y) inside or on the outline of a segment (see ``outlines``), each pair once.

    Points without coordinates match nothing.
    """
    pairs = _join(segments.select("id", "x", "y", "r", "outline"), _distinct(points), "euclidean", refine=True)
    return pairs.select(F.col("right_id").alias("point_id"), F.col("left_id").alias("segment_id")).distinct()


def pairs_within(points: DataFrame, radius: float, metric: str = "euclidean") -> DataFrame:
    """left_id < right_id, distance: pairs of points (id, x, y) at most ``radius`` apart, each once."""
    own = _distinct(points)
    return _join(own.withColumn("r", F.lit(float(radius))), own, metric, ordered=True)
