"""Keys of space-filling curves, to cluster boxes in files.

Coordinates are scaled to an unsigned grid over the extent of all boxes.
Morton keys interleave bits, a plain expression. Hilbert keys walk the bits
from the top and turn the quadrant (2D), or follow Skilling's transform (any
number of axes, AIP Conf. Proc. 707, 2004) in a vectorised UDF.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import Box, centre, number


def grid_cell(value: Column, low: float, high: float, bits: int = 16) -> Column:
    """`value` scaled from [low, high] to 0 .. 2**bits - 1, clamped; the middle
    of nothing is 0."""
    top = float((1 << bits) - 1)
    if not high > low:
        return F.lit(0).cast("long")
    scaled = (value - number(low)) * number(top / (high - low))
    return F.floor(F.least(F.greatest(scaled, number(0)), number(top))).cast("long")


def _spread(x: Column, axes: int, bits: int) -> Column:
    """Puts `axes - 1` zero bits between the bits of x."""
    return reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1).cast("long")), k * axes) for k in range(bits)],
    )


def morton(cells: Sequence[Column], bits: int = 16) -> Column:
    """Bit k of axis a goes to place k * axes + a."""
    parts = [F.shiftleft(_spread(c, len(cells), bits), a) for a, c in enumerate(cells)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def hilbert_2d(x: Column, y: Column, bits: int = 16) -> Column:
    """Place of a cell along the Hilbert curve that starts at the origin and ends
    at the right end of the x axis."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(at: Column, k: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        right = F.call_function("shiftright", at["x"], k).bitwiseAND(F.lit(1).cast("long"))
        up = F.call_function("shiftright", at["y"], k).bitwiseAND(F.lit(1).cast("long"))
        mask = side - 1
        a, b = at["x"].bitwiseAND(mask), at["y"].bitwiseAND(mask)
        turned = up == 0
        flip = turned & (right == 1)
        a2, b2 = F.when(flip, mask - a).otherwise(a), F.when(flip, mask - b).otherwise(b)
        quadrant = (right * 3).bitwiseXOR(up)
        return F.struct(
            F.when(turned, b2).otherwise(a2).alias("x"), F.when(turned, a2).otherwise(b2).alias("y"), (at["d"] + quadrant * side * side).alias("d")
        )

    order = F.array(*[F.lit(k) for k in reversed(range(bits))])
    return F.aggregate(order, start, step, lambda at: at["d"])


def hilbert_nd(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of (n, axes) cells by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for a in range(axes):
            set_bit = (x[a] & q) > 0
            swap = np.where(set_bit, 0, (x[0] ^ x[a]) & low)
            x[0] ^= np.where(set_bit, low, swap)
            x[a] ^= np.where(set_bit, 0, swap) if a else 0
        q >>= 1
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[axes - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for k in reversed(range(bits)):
        for a in range(axes):
            key = (key << 1) | ((x[a] >> k) & 1)
    return key


def hilbert_3d(x: Column, y: Column, z: Column, bits: int = 16) -> Column:
    @F.pandas_udf("long")
    def key(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_nd(np.stack([a, b, c], axis=1), bits))

    return key(x, y, z)


def curve_key(b: Box, extent: Sequence[float], curve: str = "hilbert", bits: int = 16) -> Column:
    """Key of a box's centre over an extent (min_x, min_y, ..., max_x, ...)."""
    cells = [grid_cell(c, extent[k], extent[k + b.dims], bits) for k, c in enumerate(centre(b))]
    if curve == "morton":
        return morton(cells, bits)
    if curve != "hilbert":
        raise ValueError(f"no such curve: {curve}")
    return hilbert_2d(*cells, bits) if b.dims == 2 else hilbert_3d(*cells, bits)
