"""Rays against boxes and triangles, as columns.

A ray is an origin, a direction of any length and a greatest parameter; the
segment is origin + t * direction for t in [0, max_t], ends included.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import Box, all_of, box, number

EPSILON = 2.0**-52


@dataclass(frozen=True)
class Ray:
    """Each part is a number or a column."""

    origin: tuple
    direction: tuple
    max_t: float | Column = math.inf

    def columns(self) -> tuple[list[Column], list[Column], Column]:
        as_column = lambda v: v if isinstance(v, Column) else number(v)
        return [as_column(v) for v in self.origin], [as_column(v) for v in self.direction], as_column(self.max_t)

    def numbers(self) -> list[float] | None:
        parts = [*self.origin, *self.direction, self.max_t]
        return None if any(isinstance(p, Column) for p in parts) else [float(p) for p in parts]

    def segment_box(self) -> Box | None:
        """Bounds of the segment if all parts are numbers and it ends: a filter
        that the scan can use. They are widened by a few units in the last
        place, so rounding drops no hit."""
        values = self.numbers()
        if values is None or not all(map(math.isfinite, values)):
            return None
        ends = [(o, o + d * self.max_t) for o, d in zip(self.origin, self.direction)]
        slack = [8 * EPSILON * (abs(a) + abs(b)) for a, b in ends]
        return box(*[min(e) - s for e, s in zip(ends, slack)], *[max(e) + s for e, s in zip(ends, slack)])


def ray_columns(dims: int, table: str | None = None) -> Ray:
    """The ray stored in columns ox, oy, (oz), dx, dy, (dz), max_t."""
    dot = f"{table}." if table else ""
    axes = "xyz"[:dims]
    return Ray(tuple(F.col(f"{dot}o{a}") for a in axes), tuple(F.col(f"{dot}d{a}") for a in axes), F.col(f"{dot}max_t"))


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != math.inf)


def enter_t(ray: Ray, b: Box) -> Column:
    """Parameter where the ray enters the box (0 if it starts inside), null if
    it misses. A zero direction tests whether the origin is in the slab."""
    origin, direction, most = ray.columns()
    near, far, inside = [number(0)], [most], []
    for o, d, low, high in zip(origin, direction, b.low, b.high):
        still = d == 0
        one, two = (low - o) / F.when(~still, d), (high - o) / F.when(~still, d)
        # 0 * inf is NaN and says nothing about this side
        near.append(F.when(still, number(-math.inf)).otherwise(F.nanvl(F.least(one, two), number(-math.inf))))
        far.append(F.when(still, number(math.inf)).otherwise(F.when(F.isnan(one) | F.isnan(two), number(math.inf)).otherwise(F.greatest(one, two))))
        inside.append(~still | ((low <= o) & (o <= high)))
    start, end = F.greatest(*near), F.least(*far)
    good = all_of([*map(_finite, origin), *map(_finite, direction), ~F.isnan(most), most >= 0, *inside])
    return F.when(good & (start <= end), start)


def hits(ray: Ray, b: Box) -> Column:
    return enter_t(ray, b).isNotNull()


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b)])


def _size(a: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.abs(p) for p in a])


def triangle_columns(table: str | None = None) -> list[list[Column]]:
    """Corners stored in columns ax, ay, az, bx, ... cz."""
    dot = f"{table}." if table else ""
    return [[F.col(f"{dot}{corner}{axis}") for axis in "xyz"] for corner in "abc"]


def with_triangle_t(df: DataFrame, ray: Ray, triangle: Sequence[Sequence[Column]], name: str = "t") -> DataFrame:
    """`df` with the parameter at which a ray meets a triangle from either side,
    null if it misses; a determinant within rounding of 0 is a miss.

    Each step is a projection of its own, so that what later steps use several
    times is computed once."""
    origin, direction, most = ray.columns()
    a, b, c = triangle

    def step(df: DataFrame, **vectors: Sequence[Column]) -> DataFrame:
        return df.withColumns({f"__{n}{k}": v for n, vector in vectors.items() for k, v in enumerate(vector)})

    def taken(n: str, size: int = 3) -> list[Column]:
        return [F.col(f"__{n}{k}") for k in range(size)]

    kept = [F.col(x) for x in df.columns if x != name]
    df = step(df, one=[q - p for p, q in zip(a, b)], two=[q - p for p, q in zip(a, c)], s=[p - q for p, q in zip(origin, a)], d=direction, most=[most])
    one, two, s, d = map(taken, ("one", "two", "s", "d"))
    df = step(df, h=_cross(d, two), q=_cross(s, one))
    h, q = taken("h"), taken("q")
    limit = number(64 * EPSILON) * _size(d) * _size(one) * _size(two)
    df = step(df, r=[_dot(one, h), limit, _dot(s, h), _dot(d, q), _dot(two, q)])
    det, least, *tops = taken("r", 5)
    df = step(df, w=[x / F.when(F.abs(det) > least, det) for x in tops])
    u, v, t = taken("w")
    inside = (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0) & (t <= F.col("__most0"))
    return df.select(*kept, F.when(inside, t).alias(name))
