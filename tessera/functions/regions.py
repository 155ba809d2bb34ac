"""Query regions: what a box is tested against besides another box.

A region gives `overlaps_box` and `contains_box` as columns, and `bounding_box`
if a box prefilter drops nothing. Any object with these methods serves, so
callers can bring their own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import Box, all_of, any_of, box, contains, number, overlaps


class Region(Protocol):
    def overlaps_box(self, b: Box) -> Column: ...

    def contains_box(self, b: Box) -> Column: ...

    def bounding_box(self) -> Box | None: ...

    # Optional, for boxes outside Spark: `reaches(dims)`, a list (any of) of lists (all of) of half-spaces (normal, d). A box
    # meets one if n . p + d >= 0 for some point p in it.


class BoxRegion:
    def __init__(self, *bounds: float):
        self.bounds, self.box = [float(v) for v in bounds], box(*bounds)

    def overlaps_box(self, b: Box) -> Column:
        return overlaps(b, self.box)

    def contains_box(self, b: Box) -> Column:
        return contains(self.box, b)

    def bounding_box(self) -> Box:
        return self.box

    def reaches(self, dims: int) -> list:
        return [_box_reaches(self.bounds)]


def _box_reaches(bounds: Sequence[float]) -> list:
    dims = len(bounds) // 2
    unit = np.eye(dims)
    return [(unit[k], -bounds[k]) for k in range(dims)] + [(-unit[k], bounds[dims + k]) for k in range(dims)]


def _dot_range(b: Box, nx: float, ny: float) -> tuple[Column, Column]:
    """Least and greatest value of n . p over the points of a 2D box; the signs
    of n are known, so each is a sum of two products."""
    pick = lambda n, lo, hi: (hi, lo) if n < 0 else (lo, hi)
    (x0, x1), (y0, y1) = pick(nx, b.low[0], b.high[0]), pick(ny, b.low[1], b.high[1])
    return number(nx) * x0 + number(ny) * y0, number(nx) * x1 + number(ny) * y1


class ConvexPolygon:
    """A convex polygon, corners in order; convexity isn't checked. Fewer than
    three corners match nothing."""

    def __init__(self, corners: Sequence[tuple[float, float]]):
        self.corners = [(float(x), float(y)) for x, y in corners]

    def _normals(self) -> list[tuple[float, float]]:
        pairs = zip(self.corners, self.corners[1:] + self.corners[:1])
        return [(y1 - y0, x0 - x1) for (x0, y0), (x1, y1) in pairs]

    def bounding_box(self) -> Box:
        xs, ys = zip(*self.corners) if self.corners else ((math.nan,), (math.nan,))
        return box(min(xs), min(ys), max(xs), max(ys))

    def overlaps_box(self, b: Box) -> Column:
        """Separating axes: those of the box, then the normal of each edge."""
        if len(self.corners) < 3:
            return F.lit(False)
        tests = [overlaps(b, self.bounding_box())]
        for nx, ny in self._normals():
            if nx or ny:
                own = [nx * x + ny * y for x, y in self.corners]
                low, high = _dot_range(b, nx, ny)
                tests.append((low <= number(max(own))) & (high >= number(min(own))))
        return all_of(tests)

    def reaches(self, dims: int) -> list:
        if len(self.corners) < 3:
            return []
        xs, ys = zip(*self.corners)
        found = _box_reaches([min(xs), min(ys), max(xs), max(ys)])
        for nx, ny in self._normals():
            own = [nx * x + ny * y for x, y in self.corners]
            found += [(np.array([nx, ny]), -min(own)), (np.array([-nx, -ny]), max(own))]
        return [found]

    def contains_box(self, b: Box) -> Column:
        """Every corner of the box lies on the inner side of every edge."""
        area = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(self.corners, self.corners[1:] + self.corners[:1]))
        if len(self.corners) < 3 or not area:
            return F.lit(False)
        side = 1.0 if area > 0 else -1.0
        tests = []
        for (nx, ny), (x, y) in zip(self._normals(), self.corners):
            if nx or ny:
                _, high = _dot_range(b, side * nx, side * ny)
                tests.append(high <= number(side * (nx * x + ny * y)))
        return all_of(tests)


class Triangle(ConvexPolygon):
    def __init__(self, a, b, c):
        super().__init__([a, b, c])


class Frustum:
    """Six inward half-spaces n . p + d >= 0: left, right, bottom, top, near, far.

    `overlaps_box` is conservative: it takes the corner of the box furthest
    along each normal, and so never misses but may return boxes near an edge.
    There is no bounding prefilter, which would drop some of those."""

    def __init__(self, planes: Sequence[Sequence[float]]):
        if len(planes) != 6 or any(len(p) != 4 for p in planes):
            raise ValueError("a frustum has six planes of four numbers")
        self.planes = [tuple(map(float, p)) for p in planes]

    @classmethod
    def from_view_projection(cls, rows: Sequence[Sequence[float]], depth_from_zero: bool = True) -> Frustum:
        """Planes of a row-major 4x4 matrix that takes column vectors to clip
        space; depth runs from 0 or from -1 to 1."""
        m = np.asarray(rows, float).reshape(4, 4)
        near = m[2] if depth_from_zero else m[3] + m[2]
        return cls([m[3] + m[0], m[3] - m[0], m[3] + m[1], m[3] - m[1], near, m[3] - m[2]])

    def _reach(self, b: Box, outer: bool) -> Column:
        tests = []
        for *normal, d in self.planes:
            total = number(d)
            for n, low, high in zip(normal, b.low, b.high):
                total = total + number(n) * (high if (n >= 0) == outer else low)
            tests.append(total >= 0)
        return all_of(tests)

    def overlaps_box(self, b: Box) -> Column:
        return self._reach(b, True)

    def contains_box(self, b: Box) -> Column:
        return self._reach(b, False)

    def bounding_box(self) -> None:
        return None

    def reaches(self, dims: int) -> list:
        return [[(np.array(n), d) for *n, d in self.planes]]

    def corners_box(self) -> tuple[float, ...] | None:
        """Bounds of the eight corners, or None if planes are (nearly) parallel."""
        planes, found = np.array(self.planes), []
        for side in itertools.product((0, 1), (2, 3), (4, 5)):
            a, d = planes[list(side), :3], planes[list(side), 3]
            scale = np.prod(np.linalg.norm(a, axis=1))
            if abs(np.linalg.det(a)) < 1e-9 * scale or not scale:
                return None
            found.append(np.linalg.solve(a, -d))
        return (*np.min(found, axis=0).tolist(), *np.max(found, axis=0).tolist())


class AnyRegion:
    """The union of regions; boxes in several are found once."""

    def __init__(self, regions: Sequence[Region]):
        self.regions = list(regions)

    def overlaps_box(self, b: Box) -> Column:
        return any_of([r.overlaps_box(b) for r in self.regions]) if self.regions else F.lit(False)

    def contains_box(self, b: Box) -> Column:
        return any_of([r.contains_box(b) for r in self.regions]) if self.regions else F.lit(False)

    def reaches(self, dims: int) -> list:
        return [one for r in self.regions for one in r.reaches(dims)]

    def bounding_box(self) -> None:
        return None
