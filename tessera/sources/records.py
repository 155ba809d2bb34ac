"""Binary records that containers carry as payloads, and which properties go
into a feature's JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 24-byte feature reference; all ones mean "none".
REFERENCE = np.dtype([("row_number", "<u8"), ("row_group", "<u4"), ("row_in_group", "<u4"), ("part", "<u2"), ("zero", "V6")])
NONE = {"row_group": 0xFFFFFFFF, "row_in_group": 0xFFFFFFFF, "part": 0xFFFF}
REFERENCE_TYPE = T.StructType(
    [T.StructField("row_number", T.LongType()), T.StructField("row_group", T.LongType()), T.StructField("row_in_group", T.LongType()), T.StructField("part", T.IntegerType())]
)


@F.pandas_udf(T.BinaryType())
def encode_reference(row_number: pd.Series, row_group: pd.Series, row_in_group: pd.Series, part: pd.Series, body: pd.Series) -> pd.Series:
    """A reference, followed by a body (WKB or JSON bytes) if there is one."""
    rows = np.zeros(len(row_number), REFERENCE)
    rows["row_number"] = row_number
    for name, column in (("row_group", row_group), ("row_in_group", row_in_group), ("part", part)):
        rows[name] = column.fillna(NONE[name]).astype(np.int64)
    raw = rows.tobytes()
    size = REFERENCE.itemsize
    return pd.Series([raw[k * size : (k + 1) * size] + (b"" if b is None else bytes(b)) for k, b in enumerate(body)])


@F.pandas_udf(REFERENCE_TYPE)
def decode_reference(payload: pd.Series) -> pd.DataFrame:
    """Nulls for payloads that are too short or whose reserved bytes aren't zero."""
    size = REFERENCE.itemsize
    good = [p is not None and len(p) >= size and not any(p[18:size]) for p in payload]
    rows = np.frombuffer(b"".join(bytes(p[:size]) for p, g in zip(payload, good) if g), REFERENCE)
    out = pd.DataFrame({n: pd.Series([None] * len(payload), dtype="Int64") for n in REFERENCE_TYPE.names})
    for name in REFERENCE_TYPE.names:
        values = rows[name].astype(np.int64)
        out.loc[good, name] = pd.array(np.where(values == NONE.get(name, -1), -1, values), "Int64")
        if name in NONE:
            out[name] = out[name].mask(out[name] == -1)
    out["part"] = out["part"].astype("Int32")
    return out


@F.pandas_udf(T.BinaryType())
def reference_body(payload: pd.Series) -> pd.Series:
    """What follows the reference."""
    return pd.Series([None if p is None else bytes(p[REFERENCE.itemsize :]) for p in payload])


def triangles_to_bytes(corners: np.ndarray, single: bool = False) -> list[bytes]:
    """Records of (n, 6 or 9) corner coordinates."""
    rows = np.ascontiguousarray(corners, "<f4" if single else "<f8")
    if rows.ndim != 2 or rows.shape[1] not in (6, 9):
        raise ValueError("a triangle has 6 or 9 coordinates")
    raw, size = rows.tobytes(), rows.shape[1] * rows.itemsize
    return [raw[k * size : (k + 1) * size] for k in range(len(rows))]


def triangles_from_bytes(records: Sequence[bytes], dims: int, single: bool = False) -> np.ndarray:
    """Corner coordinates; every record must have the one size of its kind."""
    size = 3 * dims * (4 if single else 8)
    if any(len(r) != size for r in records):
        raise ValueError(f"a record isn't {size} bytes")
    return np.frombuffer(b"".join(records), "<f4" if single else "<f8").reshape(-1, 3 * dims)


def projected_properties(columns: Sequence[str], geometry: str, kind: str = "all", names: Sequence[str] = ()) -> list[str]:
    """Columns of a feature's properties: "none", "all", "include" or "exclude"
    with names. A name to include that isn't there is an error."""
    rest = [c for c in columns if c != geometry]
    if kind == "none":
        return []
    if kind == "all":
        return rest
    if kind == "exclude":
        return [c for c in rest if c not in set(names)]
    if kind != "include":
        raise ValueError(f"unknown projection {kind}")
    if missing := [n for n in names if n not in rest]:
        raise ValueError(f"no such properties: {missing}")
    return list(names)


def project_properties(features: DataFrame, kind: str = "all", names: Sequence[str] = ()) -> DataFrame:
    """Features whose properties (JSON text) hold only what the projection
    names. A feature without one of the names has the others. Names keep their
    order in the text, and values their text but for white space."""
    if kind not in ("none", "all", "include", "exclude"):
        raise ValueError(f"unknown projection {kind}")
    if kind == "all":
        return features
    wanted = frozenset(names if kind != "none" else ())

    @F.pandas_udf(T.StringType())
    def keep(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            return json.dumps({k: v for k, v in json.loads(text).items() if (k in wanted) != (kind == "exclude")})

        return pd.Series([one(t) for t in texts], dtype=object)

    own: Column = F.when(F.col("properties").isNotNull(), F.lit("{}")) if kind == "none" else keep("properties")
    return features.withColumn("properties", own)
