"""Boxes as columns, and predicates and distances on them.

A box is two lists of columns, its lower and upper corner, so the same
functions serve 2D and 3D, stored columns and literals. Everything here is a
native column expression: comparisons of a stored column with a literal reach
the Parquet scan as pushed filters.

Spark orders NaN above every number, so comparisons with NaN bounds would be
true; a box with a NaN bound matches nothing here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def number(value: float) -> Column:
    return F.lit(float(value))


@dataclass(frozen=True)
class Box:
    low: tuple[Column, ...]
    high: tuple[Column, ...]
    #: Literal bounds, if this isn't made of stored columns.
    values: tuple[float, ...] | None = None

    @property
    def dims(self) -> int:
        return len(self.low)

    @property
    def bounds(self) -> tuple[Column, ...]:
        return (*self.low, *self.high)

    def never(self) -> bool:
        """A literal box that nothing can match."""
        return self.values is not None and any(math.isnan(v) for v in self.values)


def box_names(dims: int, prefix: str = "") -> list[str]:
    return [f"{prefix}{side}_{a}" for side in ("min", "max") for a in AXES[:dims]]


def box_columns(dims: int = 2, prefix: str = "", table: str | None = None) -> Box:
    """The box stored in columns min_x, min_y, ... max_x, max_y, ..."""
    names = [f"{table}.{n}" if table else n for n in box_names(dims, prefix)]
    columns = [F.col(n) for n in names]
    return Box(tuple(columns[:dims]), tuple(columns[dims:]))


def box(*values: float) -> Box:
    """A literal: box(min_x, min_y, max_x, max_y), or six numbers in 3D."""
    if len(values) not in (4, 6):
        raise ValueError("a box has 4 or 6 bounds")
    dims = len(values) // 2
    columns = [number(v) for v in values]
    return Box(tuple(columns[:dims]), tuple(columns[dims:]), tuple(float(v) for v in values))


def checked_box(*values: float) -> Box:
    """A literal box that is refused if a bound is NaN or a lower bound exceeds its upper."""
    dims = len(values) // 2
    if any(not low <= high for low, high in zip(values[:dims], values[dims:])):
        raise ValueError(f"not a box: {values}")
    return box(*values)


def point_box(*point: float) -> Box:
    return box(*point, *point)


def _comparable(b: Box) -> list[Column]:
    """Guards for boxes whose columns aren't known to be free of NaN."""
    return [] if b.values is not None else [~F.isnan(c) for c in b.bounds]


def overlaps(a: Box, b: Box, guard: bool = False) -> Column:
    """Closed boxes share a point: edges that touch count. Inverted literal
    boxes are answered by the same comparisons."""
    if a.never() or b.never():
        return F.lit(False)
    parts = [lo <= hi for lo, hi in zip(a.low, b.high)] + [hi >= lo for hi, lo in zip(a.high, b.low)]
    return all_of(parts + (_comparable(a) + _comparable(b) if guard else []))


def contains(a: Box, b: Box) -> Column:
    """`a` holds all of `b`."""
    if a.never() or b.never():
        return F.lit(False)
    return all_of([x <= y for x, y in zip(a.low, b.low)] + [x >= y for x, y in zip(a.high, b.high)])


def contains_point(a: Box, point: Sequence[Column | float]) -> Column:
    p = [x if isinstance(x, Column) else number(x) for x in point]
    if any(not isinstance(x, Column) and math.isnan(x) for x in point):
        return F.lit(False)
    return all_of([lo <= x for lo, x in zip(a.low, p)] + [hi >= x for hi, x in zip(a.high, p)])


def is_valid(b: Box) -> Column:
    return all_of([~F.isnan(c) for c in b.bounds] + [lo <= hi for lo, hi in zip(b.low, b.high)])


def _square_sum(gaps: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [g * g for g in gaps])


def distance_squared(b: Box, point: Sequence[Column | float]) -> Column:
    """Squared distance from a point to the box, 0 inside."""
    p = [x if isinstance(x, Column) else number(x) for x in point]
    return _square_sum([F.greatest(lo - x, x - hi, number(0)) for lo, hi, x in zip(b.low, b.high, p)])


def gap_squared(a: Box, b: Box) -> Column:
    """Squared distance between two boxes; a NaN bound leaves no gap on its axis."""
    gaps = []
    for k in range(a.dims):
        one, two = b.low[k] - a.high[k], a.low[k] - b.high[k]
        gaps.append(F.greatest(F.nanvl(one, number(0)), F.nanvl(two, number(0)), number(0)))
    return _square_sum(gaps)


def centre(b: Box) -> list[Column]:
    return [(lo + hi) / 2 for lo, hi in zip(b.low, b.high)]


def extent_of(dims: int = 2, prefix: str = "") -> list[Column]:
    """Aggregates for the bounds of all rows, named like one row's bounds."""
    names = box_names(dims, prefix)
    return [F.min(n).alias(n) for n in names[:dims]] + [F.max(n).alias(n) for n in names[dims:]]
