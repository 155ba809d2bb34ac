"""Exact tests of geometries against boxes, polygons and radii.

Planar intersection counts touching. It runs vectorised over batches in a
pandas UDF; candidates come from box comparisons that the scan prunes by.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geodesy
from tessera.functions.boxes import Box
from tessera.sources.wkb import Geometry, decode, plain_points

Ring = Sequence[tuple[float, float]]


class UnsupportedGeometry(ValueError):
    pass


class NonPlanar(ValueError):
    """A planar test was asked of a source with edges on a sphere."""


def check_planar(edges: str, treat_as_planar: bool) -> None:
    if edges != "planar" and not treat_as_planar:
        raise NonPlanar("edges are spherical: say treat_as_planar to test them on the plane")


def is_projected(crs: str | None) -> bool:
    """Whether a coordinate system's text speaks of projected coordinates."""
    text = (crs or "").lower().replace(" ", "")
    if "crs84" in text or "4326" in text:
        return False
    return any(word in text for word in ("projected", "projcrs", "projcs", "3857", "3395"))


def _segments(rings: list[np.ndarray], closed: bool) -> np.ndarray:
    """(n, 4) from consecutive points."""
    found = []
    for r in rings:
        p = r[:, :2]
        if closed and len(p) and (p[0] != p[-1]).any():
            p = np.vstack([p, p[:1]])
        if len(p) == 1:
            found.append(np.hstack([p, p]))
        elif len(p) > 1:
            found.append(np.hstack([p[:-1], p[1:]]))
    return np.vstack(found) if found else np.zeros((0, 4))


def _turn(ax, ay, bx, by, cx, cy):
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _between(ax, ay, bx, by, px, py):
    return (np.minimum(ax, bx) <= px) & (px <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= py) & (py <= np.maximum(ay, by))


#: Pairs of a point or segment with an edge that are held at once.
PAIRS = 1 << 18


def _crossings(segments: np.ndarray, x, y) -> tuple[np.ndarray, np.ndarray]:
    """Whether each segment holds the point, and whether a ray from it crosses the segment."""
    ax, ay, bx, by = segments.T
    on = (_turn(ax, ay, bx, by, x, y) == 0) & _between(ax, ay, bx, by, x, y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = ax + (y - ay) * (bx - ax) / (by - ay)
    return on, ((ay > y) != (by > y)) & (x < at)


def points_in(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Inside by the parity of crossings, or on an edge; holes are rings too."""
    found = np.zeros(len(points), bool)
    step = max(1, PAIRS // max(1, len(segments)))
    for k in range(0, len(points) if len(segments) else 0, step):
        on, cross = _crossings(segments, points[k : k + step, :1], points[k : k + step, 1:2])
        found[k : k + step] = on.any(axis=1) | (cross.sum(axis=1) % 2 == 1)
    return found


def segments_touching(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of the first segments share a point with any of the second."""
    found = np.zeros(len(one), bool)
    step = max(1, PAIRS // max(1, len(two)))
    args = lambda u, v, w: (u[..., 0], u[..., 1], v[..., 0], v[..., 1], w[..., 0], w[..., 1])
    for k in range(0, len(one) if len(two) else 0, step):
        a, b = one[k : k + step, None, :], two[None, :, :]
        p, q, r, s = a[..., :2], a[..., 2:], b[..., :2], b[..., 2:]
        d1, d2, d3, d4 = _turn(*args(p, q, r)), _turn(*args(p, q, s)), _turn(*args(r, s, p)), _turn(*args(r, s, q))
        cross = (d1 * d2 < 0) & (d3 * d4 < 0)
        for d, (u, v, w) in ((d1, (p, q, r)), (d2, (p, q, s)), (d3, (r, s, p)), (d4, (r, s, q))):
            cross |= (d == 0) & _between(*args(u, v, w))
        found[k : k + step] = cross.any(axis=1)
    return found


class Area:
    """A polygon with holes, or several."""

    def __init__(self, polygons: Sequence[Sequence[Ring]]):
        self.polygons = [_segments([np.asarray(r, float).reshape(-1, 2) for r in rings], True) for rings in polygons]
        corners = np.vstack([p.reshape(-1, 2) for p in self.polygons]) if self.polygons else np.zeros((0, 2))
        self.bounds = (*corners.min(axis=0), *corners.max(axis=0)) if len(corners) else None

    @classmethod
    def box(cls, x0: float, y0: float, x1: float, y1: float) -> Area:
        return cls([[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]])

    def meets(self, g: Geometry) -> bool:
        return bool(self.meets_each([g])[0])

    def holds(self, points: np.ndarray) -> np.ndarray:
        found = np.zeros(len(points), bool)
        if self.bounds is not None:
            near = np.flatnonzero((points >= self.bounds[:2]).all(axis=1) & (points <= self.bounds[2:]).all(axis=1))
            for polygon in self.polygons:
                found[near] |= points_in(points[near], polygon)
        return found

    def meets_each(self, geometries: Sequence[Geometry]) -> np.ndarray:
        """For many geometries at once: the segments of all their simple parts lie in one array."""
        found, rows, segments, areal = np.zeros(len(geometries), bool), [], [], []
        for k, g in enumerate(geometries if self.bounds is not None else []):
            for s in g.simple():
                if s.is_empty:
                    continue
                closed = isinstance(s.coordinates, list)
                own = _segments([r for r in (s.coordinates if closed else [s.coordinates]) if len(r)], closed)
                corners = own.reshape(-1, 2)
                if (corners.max(axis=0) >= self.bounds[:2]).all() and (corners.min(axis=0) <= self.bounds[2:]).all():
                    rows.append(k)
                    segments.append(own)
                    areal.append(closed)
        if rows:
            starts = np.concatenate(([0], np.cumsum([len(s) for s in segments])[:-1]))
            np.logical_or.at(found, rows, self._hits(np.vstack(segments), starts, np.array(areal)))
        return found

    def _hits(self, segments: np.ndarray, starts: np.ndarray, areal: np.ndarray) -> np.ndarray:
        """Which parts, whose segments begin at `starts`, meet the area: their first point lies in it, a segment
        touches an edge, or an areal part holds a corner of it."""
        hit = np.zeros(len(starts), bool)
        for polygon in self.polygons:
            if len(polygon):
                on, cross = _crossings(segments, *polygon[0, :2])
                holds = np.logical_or.reduceat(on, starts) | (np.add.reduceat(cross.astype(np.int64), starts) % 2 == 1)
                touch = np.logical_or.reduceat(segments_touching(segments, polygon), starts)
                hit |= points_in(segments[starts, :2], polygon) | touch | areal & holds
        return hit

    def meets_boxes(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
        found = np.zeros(len(x0), bool)
        if self.bounds is not None:
            bx0, by0, bx1, by1 = self.bounds
            near = np.flatnonzero((x1 >= bx0) & (x0 <= bx1) & (y1 >= by0) & (y0 <= by1))
            a, b, c, d = (v[near] for v in (x0, y0, x1, y1))
            sides = np.stack([np.stack(v, 1) for v in ((a, b, c, b), (c, b, c, d), (c, d, a, d), (a, d, a, b))], 1).reshape(-1, 4)
            if len(near):
                found[near] = self._hits(sides, np.arange(len(near)) * 4, np.ones(len(near), bool))
        return found


def intersects(geometry: Column, area: Area) -> Column:
    """Geometry (WKB) shares a point with the area; null and empty ones don't."""

    @F.pandas_udf(T.BooleanType())
    def test(data: pd.Series) -> pd.Series:
        raw = data.tolist()
        at, points = plain_points(raw)
        found = np.zeros(len(raw), bool)
        found[at] = area.holds(points)
        rest = [k for k in np.setdiff1d(np.arange(len(raw)), at) if raw[k] is not None]
        if rest:
            found[rest] = area.meets_each([decode(bytes(raw[k])) for k in rest])
        return pd.Series(found)

    return test(geometry)


class RectanglesMeet:
    """A region for box searches: stored boxes against a polygon with holes."""

    def __init__(self, area: Area):
        self.area = area

    def bounding_box(self) -> Box:
        from tessera.functions.boxes import box

        return box(*(self.area.bounds or (float("nan"),) * 4))

    def overlaps_box(self, b: Box) -> Column:
        area = self.area

        @F.pandas_udf(T.BooleanType())
        def test(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
            return pd.Series(area.meets_boxes(*(v.to_numpy(np.float64) for v in (x0, y0, x1, y1))))

        return test(*b.bounds)

    def contains_box(self, b: Box) -> Column:
        return F.lit(False)


def within_radius(geometry: Column, lon: float, lat: float, metres: float) -> Column:
    """Points and multipoints with a point within a great-circle distance; any
    other kind is an error."""
    limit = float(metres)

    @F.pandas_udf(T.BooleanType())
    def test(data: pd.Series) -> pd.Series:
        raw = data.tolist()
        at, points = plain_points(raw)
        found, owners, places = np.zeros(len(raw), bool), [at], [points]
        for k in np.setdiff1d(np.arange(len(raw)), at):
            if raw[k] is not None:
                g = decode(bytes(raw[k]))
                if g.kind not in ("Point", "MultiPoint"):
                    raise UnsupportedGeometry(f"a radius needs points, not {g.kind}")
                for a in g.arrays():
                    owners.append(np.full(len(a), k))
                    places.append(a[:, :2])
        p, x, y = np.radians(np.vstack(places)), np.radians(lon), np.radians(lat)
        h = np.sin((p[:, 1] - y) / 2) ** 2 + np.cos(y) * np.cos(p[:, 1]) * np.sin((p[:, 0] - x) / 2) ** 2
        np.logical_or.at(found, np.concatenate(owners), 2 * geodesy.EARTH_RADIUS * np.arcsin(np.minimum(1, np.sqrt(h))) <= limit)
        return pd.Series(found)

    return test(geometry)
