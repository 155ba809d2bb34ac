"""Boxes in single precision that lose no answer.

Stored boxes are rounded outward and query boxes inward-compatible, so a
search over the rounded boxes returns every exact match and perhaps a few more.
Spark has no neighbouring-float function, so rounding runs vectorised in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boxes import box_names


def down(values: np.ndarray) -> np.ndarray:
    """The greatest single not above each number."""
    with np.errstate(over="ignore"):
        near = np.asarray(values, np.float64).astype(np.float32)
    return np.where(near.astype(np.float64) > values, np.nextafter(near, np.float32(-np.inf)), near)


def up(values: np.ndarray) -> np.ndarray:
    """The least single not below each number."""
    with np.errstate(over="ignore"):
        near = np.asarray(values, np.float64).astype(np.float32)
    return np.where(near.astype(np.float64) < values, np.nextafter(near, np.float32(np.inf)), near)


@F.pandas_udf(T.FloatType())
def round_down(x: pd.Series) -> pd.Series:
    return pd.Series(down(x.to_numpy(np.float64)))


@F.pandas_udf(T.FloatType())
def round_up(x: pd.Series) -> pd.Series:
    return pd.Series(up(x.to_numpy(np.float64)))


def outward(df: DataFrame, dims: int = 2) -> DataFrame:
    """`df` with its bounds as FLOAT columns, each box holding the exact one."""
    names = box_names(dims)
    return df.withColumns({n: (round_down if k < dims else round_up)(F.col(n)) for k, n in enumerate(names)})


def inward_literal(*bounds: float) -> list[float]:
    """A query box for rounded boxes: upper bounds rounded down and lower bounds
    up change no comparison with singles."""
    dims = len(bounds) // 2
    return [*up(np.array(bounds[:dims])).tolist(), *down(np.array(bounds[dims:])).tolist()]


def inward_columns(df: DataFrame, dims: int = 2, prefix: str = "") -> dict[str, Column]:
    names = box_names(dims, prefix)
    return {n: (round_up if k < dims else round_down)(F.col(n)) for k, n in enumerate(names)}
