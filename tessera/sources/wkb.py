"""Well-known binary geometry: bounds, decoding and encoding.

Reads ISO and extended (flagged) type codes, both byte orders, Z and M, an
SRID, and the types Point to GeometryCollection plus curves, surfaces, TIN and
triangle, whose members are read alike. Bytes that lie about their counts,
nest too deeply or hold coordinates that aren't finite are refused.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEEPEST = 128
# Type codes of the format.
KINDS = {
    1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection",
    8: "CircularString", 9: "CompoundCurve", 10: "CurvePolygon", 11: "MultiCurve", 12: "MultiSurface", 15: "PolyhedralSurface", 16: "TIN", 17: "Triangle",
}
CODES = {name: code for code, name in KINDS.items()}
RINGED = {"Polygon", "Triangle"}
LISTED = {"LineString", "CircularString"}


class WkbError(ValueError):
    pass


@dataclass
class Geometry:
    """`coordinates`: (n, 2 to 4) arrays: one for a point or line, a list of
    rings for a polygon; members of anything else are in `parts`."""

    kind: str
    has_z: bool = False
    has_m: bool = False
    coordinates: np.ndarray | list[np.ndarray] | None = None
    parts: list[Geometry] = field(default_factory=list)

    def arrays(self) -> Iterator[np.ndarray]:
        if isinstance(self.coordinates, list):
            yield from self.coordinates
        elif self.coordinates is not None:
            yield self.coordinates
        for part in self.parts:
            yield from part.arrays()

    def simple(self) -> Iterator[Geometry]:
        """Points, lines and polygons of any depth."""
        if self.parts or self.coordinates is None:
            for part in self.parts:
                yield from part.simple()
        else:
            yield self

    @property
    def is_empty(self) -> bool:
        return not any(len(a) for a in self.arrays())


def decode(data: bytes) -> Geometry:
    found, end = _decode(memoryview(data), 0, 0)
    if end != len(data):
        raise WkbError("bytes are left after the geometry")
    return found


def _decode(data: memoryview, at: int, depth: int) -> tuple[Geometry, int]:
    if depth > DEEPEST:
        raise WkbError("nested too deeply")
    if len(data) < at + 5 or data[at] > 1:
        raise WkbError("not a geometry")
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    has_z, has_m, has_srid = bool(code & 0x80000000), bool(code & 0x40000000), bool(code & 0x20000000)
    code &= 0x1FFFFFFF
    has_z, has_m, code = has_z or code // 1000 in (1, 3), has_m or code // 1000 in (2, 3), code % 1000 if code < 4000 else code
    if code not in KINDS:
        raise WkbError(f"unknown geometry type {code}")
    at += 4 * has_srid
    kind, width = KINDS[code], 2 + has_z + has_m

    def count(unit: int) -> int:
        nonlocal at
        if len(data) < at + 4:
            raise WkbError("cut short")
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        if n * unit > len(data) - at:
            raise WkbError("a count exceeds the bytes that are left")
        return n

    def points(n: int) -> np.ndarray:
        nonlocal at
        if len(data) < at + 8 * width * n:
            raise WkbError("cut short")
        found = np.frombuffer(data, order + "f8", n * width, at).reshape(n, width).astype(np.float64)
        at += 8 * width * n
        return found

    if kind == "Point":
        found = points(1)
        return Geometry(kind, has_z, has_m, found[:0] if np.isnan(found).all() else found), at
    if kind in LISTED:
        return Geometry(kind, has_z, has_m, points(count(8 * width))), at
    if kind in RINGED:
        return Geometry(kind, has_z, has_m, [points(count(8 * width)) for _ in range(count(4))]), at
    parts = []
    for _ in range(count(5)):
        part, at = _decode(data, at, depth + 1)
        parts.append(part)
    return Geometry(kind, has_z or any(p.has_z for p in parts), has_m or any(p.has_m for p in parts), None, parts), at


def encode(g: Geometry) -> bytes:
    """Little-endian ISO bytes."""
    head = struct.pack("<BI", 1, CODES[g.kind] + 1000 * g.has_z + 2000 * g.has_m)
    raw = lambda a: np.ascontiguousarray(a, "<f8").tobytes()
    if g.kind == "Point":
        return head + (raw(g.coordinates) if len(g.coordinates) else struct.pack("<d", math.nan) * (2 + g.has_z + g.has_m))
    if g.kind in LISTED:
        return head + struct.pack("<I", len(g.coordinates)) + raw(g.coordinates)
    if g.kind in RINGED:
        return head + struct.pack("<I", len(g.coordinates)) + b"".join(struct.pack("<I", len(r)) + raw(r) for r in g.coordinates)
    return head + struct.pack("<I", len(g.parts)) + b"".join(map(encode, g.parts))


def from_geojson(value: dict) -> Geometry:
    """A geometry object; positions with more than two numbers have a Z."""
    kind = value.get("type")
    if kind not in CODES or CODES[kind] > 7:
        raise WkbError(f"unknown geometry type {kind}")
    if kind == "GeometryCollection":
        parts = [from_geojson(v) for v in value.get("geometries") or []]
        return Geometry(kind, any(p.has_z for p in parts), False, None, parts)

    def array(positions) -> np.ndarray:
        try:
            size = max((len(p) for p in positions), default=2)
            found = np.array([[float(v) for v in p[:3]] for p in positions], np.float64).reshape(len(positions), min(size, 3))
        except (TypeError, ValueError) as e:
            raise WkbError(f"bad coordinates: {e}") from None
        if size < 2 or not np.isfinite(found).all():
            raise WkbError("coordinates must be finite numbers")
        return found

    c = value.get("coordinates")
    c = [] if c is None else c
    if kind.startswith("Multi"):
        parts = [from_geojson({"type": kind[5:], "coordinates": v}) for v in c]
        return Geometry(kind, any(p.has_z for p in parts), False, None, parts)
    if kind == "Polygon":
        rings = [array(r) for r in c]
        return Geometry(kind, any(r.shape[1] > 2 for r in rings), False, rings)
    found = array([c] if kind == "Point" and c else c)
    return Geometry(kind, found.shape[1] > 2, False, found)


def to_geojson(g: Geometry) -> dict:
    """M values are dropped."""
    rows = lambda a: a[:, : 2 + g.has_z].tolist()
    if g.kind == "GeometryCollection":
        return {"type": g.kind, "geometries": [to_geojson(p) for p in g.parts]}
    if g.kind == "Point":
        return {"type": g.kind, "coordinates": rows(g.coordinates)[0] if len(g.coordinates) else []}
    if g.kind == "LineString":
        return {"type": g.kind, "coordinates": rows(g.coordinates)}
    if g.kind == "Polygon":
        return {"type": g.kind, "coordinates": [rows(r) for r in g.coordinates]}
    if g.kind.startswith("Multi") and g.kind[5:] in ("Point", "LineString", "Polygon"):
        return {"type": g.kind, "coordinates": [to_geojson(p)["coordinates"] for p in g.parts]}
    raise WkbError(f"{g.kind} has no such form")


def shortest_arc(longitudes: np.ndarray) -> tuple[float, float]:
    """West and east end of the shortest arc over all longitudes; west exceeds
    east if it crosses the antimeridian."""
    lon = np.unique(longitudes)
    gaps = np.append(np.diff(lon), lon[0] + 360 - lon[-1])
    widest = int(np.argmax(gaps))
    if widest == len(lon) - 1 or gaps[-1] >= gaps[widest]:
        return float(lon[0]), float(lon[-1])
    return float(lon[widest + 1]), float(lon[widest])


BOUNDS = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "west", "east")]
    + [T.StructField("kind", T.StringType()), T.StructField("has_z", T.BooleanType()), T.StructField("has_m", T.BooleanType())]
)


def bounds(data: bytes | None) -> tuple | None:
    """The fields of BOUNDS, or None for a null or empty geometry. Coordinates
    that aren't finite are an error."""
    if data is None:
        return None
    g = decode(bytes(data))
    arrays = [a for a in g.arrays() if len(a)]
    if not arrays:
        return None
    xy = np.concatenate([a[:, :2] for a in arrays])
    z = np.concatenate([a[:, 2] for a in arrays if a.shape[1] > 2]) if g.has_z and any(a.shape[1] > 2 for a in arrays) else None
    if not np.isfinite(xy).all() or z is not None and not np.isfinite(z).all():
        raise WkbError("coordinates must be finite numbers")
    (x0, y0), (x1, y1) = xy.min(axis=0).tolist(), xy.max(axis=0).tolist()
    west, east = shortest_arc(xy[:, 0])
    return (x0, y0, None if z is None else float(z.min()), x1, y1, None if z is None else float(z.max()), west, east, g.kind, g.has_z, g.has_m)


# Fixed value: how a little-endian point without Z or M begins.
POINT_HEAD = b"\x01\x01\x00\x00\x00"


def plain_points(data: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Places and coordinates of the little-endian points without Z or M in a batch, read at one go. Those that
    aren't finite are left to `decode`, as is everything else."""
    at = np.array([k for k, x in enumerate(data) if x is not None and len(x) == 21 and x[:5] == POINT_HEAD], np.int64)
    raw = np.frombuffer(b"".join(data[k] for k in at), np.dtype([("head", "V5"), ("xy", "<f8", 2)]))
    points = raw["xy"].astype(np.float64).reshape(-1, 2)
    good = np.isfinite(points).all(axis=1)
    return at[good], points[good]


def bounds_of_many(data: list[bytes | None]) -> pd.DataFrame:
    """`bounds` of each, by reductions over the coordinates of all."""
    rows, arrays, found = [], [], pd.DataFrame([(None,) * len(BOUNDS)] * len(data), columns=BOUNDS.names, dtype=object)
    for k, x in enumerate(data):
        g = None if x is None else decode(bytes(x))
        own = [a for a in g.arrays() if len(a)] if g else []
        if own:
            z = [a[:, 2] for a in own if a.shape[1] > 2] if g.has_z else []
            heights = np.concatenate(z) if z else None
            if z and not np.isfinite(heights).all():
                raise WkbError("coordinates must be finite numbers")
            ends = (float(heights.min()), float(heights.max())) if z else (None, None)
            rows.append((k, sum(map(len, own)), *ends, g.kind, g.has_z, g.has_m))
            arrays += [a[:, :2] for a in own]
    if not rows:
        return found
    xy = np.concatenate(arrays)
    if not np.isfinite(xy).all():
        raise WkbError("coordinates must be finite numbers")
    at, sizes, low_z, high_z, kinds, has_z, has_m = zip(*rows)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    low, high = np.minimum.reduceat(xy, starts), np.maximum.reduceat(xy, starts)
    # The gap after each longitude; after the last of a geometry, that around the world to its first.
    owner = np.repeat(np.arange(len(rows)), sizes)
    lon = xy[np.lexsort((xy[:, 0], owner)), 0]
    last = starts + np.array(sizes) - 1
    gaps = np.append(np.diff(lon), 0.0)
    gaps[last] = lon[starts] + 360 - lon[last]
    widest = np.maximum.reduceat(gaps, starts)
    first = np.flatnonzero(gaps == widest[owner])
    first = first[np.unique(owner[first], return_index=True)[1]]
    whole = gaps[last] >= widest
    west = np.where(whole, lon[starts], lon[np.where(whole, first, first + 1)])
    east = np.where(whole, lon[last], lon[first])
    columns = (low[:, 0], low[:, 1], low_z, high[:, 0], high[:, 1], high_z, west, east, kinds, has_z, has_m)
    measured = pd.DataFrame({n: pd.Series(list(v), dtype=object) for n, v in zip(BOUNDS.names, columns)})
    found.loc[list(at)] = measured.to_numpy()
    return found


@F.pandas_udf(BOUNDS)
def wkb_bounds(data: pd.Series) -> pd.DataFrame:
    raw = data.tolist()
    at, points = plain_points(raw)
    (x, y), none = points.T, np.full(len(at), np.nan)
    found = pd.DataFrame(dict(zip(BOUNDS.names, (x, y, none, x, y, none, x, x))), index=at).assign(kind="Point", has_z=False, has_m=False)
    rest = np.setdiff1d(np.arange(len(raw)), at)
    if not len(rest):
        return found
    others = bounds_of_many([raw[k] for k in rest]).set_index(rest)
    return others if not len(at) else pd.concat([found.astype(object), others.astype(object)]).sort_index()


@F.pandas_udf(T.BinaryType())
def wkb_point(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y)])


@F.pandas_udf(T.BinaryType())
def wkb_segment(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<BIIdddd", 1, 2, 2, *v) for v in zip(x0, y0, x1, y1)])


@F.pandas_udf(T.StringType())
def wkb_to_json(data: pd.Series) -> pd.Series:
    import json

    return pd.Series([None if x is None else json.dumps(to_geojson(decode(bytes(x)))) for x in data])
