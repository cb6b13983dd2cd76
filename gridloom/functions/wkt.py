"""Reading of WKT: points as JVM expressions, outlines in batches.

Accepted spellings: any case, an ``SRID=n;`` prefix, free white space, Z/M values (ignored),
exponents.  Null, EMPTY and unreadable geometries have no coordinates.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|[-+]?[0-9]+\."
POINT = rf"(?i)^\s*(?:SRID\s*=\s*[0-9]+\s*;)?\s*POINT\s*(?:Z|M|ZM)?\s*\(\s*({_NUMBER})\s+({_NUMBER})(?:\s+[^()]*)?\)\s*$"


def point_x(geometry: Column) -> Column:
    return F.regexp_extract(geometry, POINT, 1).try_cast("double")


def point_y(geometry: Column) -> Column:
    return F.regexp_extract(geometry, POINT, 2).try_cast("double")


def outline(text: str | None) -> np.ndarray | None:
    """Coordinates of all rings of a POLYGON or MULTIPOLYGON, (n, 2), rings closed and parted by a row of NaN.

    None where there is no area to speak of: null, EMPTY, another kind, or unreadable.
    """
    if not text or "POLYGON" not in (upper := text.upper()) or "(" not in upper:
        return None
    rings = []
    try:
        for body in re.findall(r"\(([^()]+)\)", text):
            points = [p.split() for p in body.split(",")]
            ring = np.array([(p[0], p[1]) for p in points], dtype=float)
            if (ring[0] != ring[-1]).any():
                ring = np.vstack([ring, ring[:1]])
            if rings:
                rings.append(np.full((1, 2), np.nan))
            rings.append(ring)
    except (ValueError, IndexError):
        return None
    return np.vstack(rings) if rings else None


def contains(pair_outline: np.ndarray, px: np.ndarray, py: np.ndarray, edges: np.ndarray, first: np.ndarray, chunk: int = 1_000_000) -> np.ndarray:
    """For pairs of an outline number and a point: is the point inside or on a boundary?

    ``edges`` (n, 4) are the edges of all outlines one after another, those of outline i in
    ``first[i]:first[i + 1]``.  Holes are outside by the even-odd rule; every edge is boundary.
    """
    out = np.zeros(len(pair_outline), bool)
    counts = first[pair_outline + 1] - first[pair_outline]
    ends = np.cumsum(counts)
    a = 0
    while a < len(out):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + chunk, side="right")))
        n = counts[a:b]
        owner = np.repeat(np.arange(b - a), n)
        e = edges[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[pair_outline[a:b]], n)]
        x, y = px[a:b][owner], py[a:b][owner]
        x0, y0, x1, y1 = e.T
        side = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
        on = (side == 0) & (x >= np.minimum(x0, x1)) & (x <= np.maximum(x0, x1)) & (y >= np.minimum(y0, y1)) & (y <= np.maximum(y0, y1))
        crosses = ((y0 > y) != (y1 > y)) & ((side > 0) == (y1 > y0))
        out[a:b] = (np.bincount(owner, crosses, b - a) % 2 == 1) | (np.bincount(owner, on, b - a) > 0)
        a = b
    return out


def edges_of(outlines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(edges, first) for ``contains``."""
    if not outlines:
        return np.zeros((0, 4)), np.zeros(1, int)
    points = np.concatenate(outlines)
    ends = np.cumsum([len(o) for o in outlines])
    edges = np.hstack([points[:-1], points[1:]])
    real = ~np.isnan(edges).any(axis=1)
    real[ends[:-1] - 1] = False  # from one outline to the next
    before = np.r_[0, np.cumsum(real)]
    return edges[real], np.r_[0, before[np.minimum(ends, len(before) - 1)]]


_HEAD = re.compile(r"\s*(?:SRID\s*=\s*[0-9]+\s*;)?\s*(?:MULTI)?POLYGON\s*", re.IGNORECASE)


def parse_outlines(texts: list[str | None]) -> list[np.ndarray | None]:
    """``outline`` of many texts: the plain ones are read in one go, the others one by one."""
    plain, bodies = [], []
    for k, text in enumerate(texts):
        head, _, body = text.partition("(") if text else ("", "", "")
        if (head == "POLYGON " or _HEAD.fullmatch(head)) and len(body[: body.find(",")].strip(" (").split()) == 2:
            plain.append(k)
            bodies.append(body.rstrip())
    out: list[np.ndarray | None] = [None] * len(texts)
    odd = set(range(len(texts))) - set(plain)
    if plain:
        spread = " inf inf ".join(bodies).replace(",", " ").replace("(", " ").replace(")", " nan nan ")
        try:
            values = np.array(list(map(float, spread.split())))
        except ValueError:
            return [outline(t) for t in texts]
        if len(values) % 2:
            return [outline(t) for t in texts]
        points = values.reshape(-1, 2)
        if (np.isinf(points[:, 0]) != np.isinf(points[:, 1])).any() or (np.isnan(points[:, 0]) != np.isnan(points[:, 1])).any():
            return [outline(t) for t in texts]
        # a row of NaN ends a ring; more of them close polygons and outlines
        cut = np.flatnonzero(np.isinf(points[:, 0]))
        if len(cut) != len(plain) - 1:
            return [outline(t) for t in texts]
        gap = np.isnan(points[:, 0])
        keep = ~(gap & np.r_[True, (gap | np.isinf(points[:, 0]))[:-1]])
        new_cut = np.cumsum(keep)[cut] - 1
        points = points[keep]
        starts, ends = np.r_[0, new_cut + 1], np.r_[new_cut, len(points)]
        gap = np.isnan(points[:, 0])
        ring_end = np.flatnonzero(gap) - 1
        ring_start = np.r_[0, np.flatnonzero(gap | np.isinf(points[:, 0])) + 1]
        ring_start = ring_start[ring_start < len(points)]
        ring_start = ring_start[~gap[ring_start] & ~np.isinf(points[ring_start, 0])]
        if len(ring_start) != len(ring_end):
            return [outline(t) for t in texts]
        open_rings = ring_start[(points[ring_start] != points[ring_end]).any(axis=1)]
        unclosed = set(np.searchsorted(starts, open_rings, side="right") - 1)
        for n, (k, a, b) in enumerate(zip(plain, starts.tolist(), ends.tolist())):
            if n in unclosed or b - a < 2:
                odd.add(k)
            else:
                out[k] = points[a : b - 1]
    for k in odd:
        out[k] = outline(texts[k])
    return out
