"""FlatGeobuf files: a reader for the published format (version 3).

A file is a magic, a header table, an optional packed index and features in
order, tables all in FlatBuffers encoding. Offsets of features come from the
index's leaves, or from the size before each feature where there is none; runs
of features are partitions, read independently.
"""

from __future__ import annotations

import base64
import json
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import wkb
from .features import Discovery, GeometryColumn

# Fixed values of the published format: magic, geometry types, column types.
MAGIC = b"fgb\x03fgb"
GEOMETRY_TYPES = {
    0: "Unknown", 1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection",
    8: "CircularString", 9: "CompoundCurve", 10: "CurvePolygon", 11: "MultiCurve", 12: "MultiSurface", 15: "PolyhedralSurface", 16: "TIN", 17: "Triangle",
}
COLUMN_TYPES = ("byte", "ubyte", "bool", "short", "ushort", "int", "uint", "long", "ulong", "float", "double", "string", "json", "datetime", "binary")
NUMBERS = {0: "b", 1: "B", 2: "?", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d"}
TEXTS, JSON, BINARY = (11, 13), 12, 14
RUN = 4096


class FlatGeobufError(ValueError):
    pass


class Table:
    """A FlatBuffers table; fields are found through its offset list."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.fields = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.fields)[0]

    def place(self, k: int) -> int:
        slot = 4 + 2 * k
        off = struct.unpack_from("<H", self.data, self.fields + slot)[0] if slot < self.size else 0
        return self.at + off if off else 0

    def number(self, k: int, kind: str, default=0):
        p = self.place(k)
        return struct.unpack_from("<" + kind, self.data, p)[0] if p else default

    def _target(self, k: int) -> int:
        p = self.place(k)
        return p + struct.unpack_from("<I", self.data, p)[0] if p else 0

    def table(self, k: int) -> Table | None:
        p = self._target(k)
        return Table(self.data, p) if p else None

    def vector(self, k: int, kind: str) -> np.ndarray:
        p = self._target(k)
        return np.frombuffer(self.data, "<" + kind, struct.unpack_from("<I", self.data, p)[0], p + 4) if p else np.zeros(0, "<" + kind)

    def text(self, k: int) -> str | None:
        p = self._target(k)
        return self.vector(k, "u1").tobytes().decode() if p else None

    def tables(self, k: int) -> list[Table]:
        p = self._target(k)
        if not p:
            return []
        n = struct.unpack_from("<I", self.data, p)[0]
        return [Table(self.data, q + struct.unpack_from("<I", self.data, q)[0]) for q in range(p + 4, p + 4 + 4 * n, 4)]


def root(data: bytes) -> Table:
    try:
        return Table(data, struct.unpack_from("<I", data, 0)[0])
    except struct.error:
        raise FlatGeobufError("a table is cut short") from None


@dataclass(frozen=True)
class Header:
    name: str | None
    kind: str
    has_z: bool
    has_m: bool
    columns: tuple[tuple[str, int], ...]
    count: int
    node_size: int
    crs: str | None
    index_at: int
    features_at: int


def _tree_nodes(items: int, node_size: int) -> int:
    total = width = items
    while width > 1:
        width = -(-width // node_size)
        total += width
    return total


def read_header(file) -> Header:
    start = file.read(12)
    if start[:7] != MAGIC or len(start) < 12:
        raise FlatGeobufError("not such a file")
    size = struct.unpack_from("<I", start, 8)[0]
    body = file.read(size)
    if len(body) < size:
        raise FlatGeobufError("the header is cut short")
    t = root(body)
    columns = tuple((c.text(0) or "", c.number(1, "B")) for c in t.tables(7))
    count, node_size = t.number(8, "Q"), t.number(9, "H", 16)
    crs = t.table(10)
    code = f"{crs.text(0) or 'EPSG'}:{crs.number(1, 'i')}" if crs and crs.number(1, "i") else None
    index = 40 * _tree_nodes(count, node_size) if node_size and count else 0
    return Header(t.text(0), GEOMETRY_TYPES.get(t.number(2, "B"), "Unknown"), t.number(3, "?", False), t.number(4, "?", False), columns, count, node_size, code, 12 + size, 12 + size + index)


def geometry(t: Table, kind: str, has_z: bool, has_m: bool) -> wkb.Geometry:
    kind = GEOMETRY_TYPES.get(t.number(6, "B"), "Unknown") if kind == "Unknown" or t.number(6, "B") else kind
    parts = t.tables(7)
    if parts:
        inner = {"MultiPolygon": "Polygon", "MultiLineString": "LineString", "MultiPoint": "Point"}.get(kind, "Unknown")
        return wkb.Geometry(kind, has_z, has_m, None, [geometry(p, inner, has_z, has_m) for p in parts])
    columns = [t.vector(1, "f8").reshape(-1, 2)]
    columns += [t.vector(k, "f8").reshape(-1, 1) for k, there in ((2, has_z), (3, has_m)) if there]
    points, ends = np.hstack(columns), t.vector(0, "u4").astype(np.int64)
    if kind in ("Point", "LineString", "CircularString"):
        return wkb.Geometry(kind, has_z, has_m, points)
    pieces = np.split(points, ends[:-1]) if len(ends) else [points]
    if kind in wkb.RINGED:
        return wkb.Geometry(kind, has_z, has_m, pieces)
    if kind == "MultiPoint":
        return wkb.Geometry(kind, has_z, has_m, None, [wkb.Geometry("Point", has_z, has_m, p[None, :]) for p in points])
    if kind == "MultiLineString":
        return wkb.Geometry(kind, has_z, has_m, None, [wkb.Geometry("LineString", has_z, has_m, p) for p in pieces])
    raise FlatGeobufError(f"{kind} without parts")


def properties(raw: bytes, columns: tuple[tuple[str, int], ...]) -> dict:
    found, p = {}, 0
    while p + 2 <= len(raw):
        k = struct.unpack_from("<H", raw, p)[0]
        p += 2
        if k >= len(columns):
            raise FlatGeobufError("an unknown column")
        name, kind = columns[k]
        if kind in NUMBERS:
            found[name] = struct.unpack_from("<" + NUMBERS[kind], raw, p)[0]
            p += struct.calcsize("<" + NUMBERS[kind])
            continue
        n = struct.unpack_from("<I", raw, p)[0]
        value = raw[p + 4 : p + 4 + n]
        p += 4 + n
        if kind == BINARY:
            found[name] = base64.b64encode(value).decode()
        else:
            found[name] = json.loads(value) if kind == JSON else value.decode()
    return found


def feature_offsets(path: str) -> tuple[Header, list[int]]:
    """Where each feature starts, in file order."""
    with open(path.removeprefix("file://"), "rb") as f:
        head = read_header(f)
        if head.features_at > head.index_at:
            leaves = 40 * head.count
            f.seek(head.features_at - leaves)
            nodes = np.frombuffer(f.read(leaves), np.dtype([("box", "<f8", 4), ("at", "<u8")]))
            return head, sorted((head.features_at + nodes["at"].astype(np.int64)).tolist())
        offsets, at = [], head.features_at
        end = f.seek(0, 2)
        while at + 4 <= end:
            offsets.append(at)
            f.seek(at)
            at += 4 + struct.unpack("<I", f.read(4))[0]
        return head, offsets


@dataclass
class FeatureRun(InputPartition):
    first: int
    offsets: tuple[int, ...]


class FlatGeobufReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        _, offsets = feature_offsets(self.path)
        runs = [FeatureRun(k, tuple(offsets[k : k + RUN])) for k in range(0, len(offsets), RUN)]
        return runs or [FeatureRun(0, ())]

    def read(self, partition):
        with open(self.path.removeprefix("file://"), "rb") as f:
            head = read_header(f)
            for k, at in enumerate(partition.offsets):
                f.seek(at)
                size = struct.unpack("<I", f.read(4))[0]
                body = f.read(size)
                if len(body) < size:
                    raise FlatGeobufError("a feature is cut short")
                t = root(body)
                own = tuple((c.text(0) or "", c.number(1, "B")) for c in t.tables(2)) or head.columns
                g = t.table(0)
                shape = wkb.encode(geometry(g, head.kind, head.has_z, head.has_m)) if g else None
                yield partition.first + k, None, shape, json.dumps(properties(t.vector(1, "u1").tobytes(), own))


class FlatGeobufSource(DataSource):
    """Columns like every feature reader's."""

    @classmethod
    def name(cls) -> str:
        return "flatgeobuf"

    def schema(self) -> str:
        return "row_number long, feature_id string, geometry binary, properties string"

    def reader(self, schema) -> FlatGeobufReader:
        return FlatGeobufReader(self.options["path"])


def read_flatgeobuf(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FlatGeobufSource)
    return spark.read.format("flatgeobuf").load(path)


def discover_flatgeobuf(path: str) -> Discovery:
    """From the header; a count of 0 there means that it isn't known, then features are counted."""
    head, offsets = feature_offsets(path)
    kinds = () if head.kind == "Unknown" else (head.kind + " Z" * head.has_z,)
    schema = (("geometry", "geometry"), *((n, COLUMN_TYPES[t] if t < len(COLUMN_TYPES) else "unknown") for n, t in head.columns))
    return Discovery((GeometryColumn("geometry", "WKB", kinds, head.crs),), "geometry", head.count or len(offsets), 1, schema)
