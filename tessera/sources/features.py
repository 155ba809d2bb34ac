"""Geographic features from GeoJSON, GeoParquet and GeoArrow columns.

Every reader gives the same columns: row_number (position in the source, files
in path order), row_group and row_in_group where the source has them,
feature_id, geometry (WKB) and properties (JSON text).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wkb

FEATURES = "row_number long, feature_id string, geometry binary, properties string"


class FeatureError(ValueError):
    pass


class AmbiguousGeometry(FeatureError):
    pass


# -- GeoJSON -----------------------------------------------------------------


def feature_id(value) -> str | None:
    """Text stays, any other JSON value is written out, null is none."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _feature(value: dict) -> tuple[str | None, bytes | None, str | None]:
    if value.get("type") != "Feature":
        raise FeatureError(f"not a feature: {value.get('type')}")
    g, properties = value.get("geometry"), value.get("properties")
    return (
        feature_id(value.get("id")),
        None if g is None else wkb.encode(wkb.from_geojson(g)),
        None if properties is None else json.dumps(properties),
    )


def geojson_features(text: str) -> list[tuple[str | None, bytes | None, str | None]]:
    """Features of a document: a collection, a feature, or a bare geometry."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError as e:
        raise FeatureError(f"not JSON: {e}") from None
    kind = value.get("type") if isinstance(value, dict) else None
    if kind == "FeatureCollection":
        return [_feature(v) for v in value.get("features") or []]
    if kind == "Feature":
        return [_feature(value)]
    if kind in wkb.CODES:
        return [(None, wkb.encode(wkb.from_geojson(value)), None)]
    raise FeatureError("neither features nor a geometry")


def _numbered(rows: DataFrame) -> DataFrame:
    """Row numbers over files from (path, place): sums of the files before."""
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("before"))
    return rows.join(before, "path").withColumn("row_number", F.col("before") + F.col("place")).drop("path", "place", "before", "n")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents, one for each file."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def parse(frames):
        for frame in frames:
            for p, text in zip(frame["path"], frame["value"]):
                rows = geojson_features(text)
                out = pd.DataFrame(rows, columns=["feature_id", "geometry", "properties"])
                out.insert(0, "path", p)
                out.insert(1, "place", range(len(rows)))
                yield out

    schema = "path string, place long, feature_id string, geometry binary, properties string"
    return _numbered(texts.mapInPandas(parse, schema)).select("row_number", "feature_id", "geometry", "properties")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """One feature in each line: files of any size, split among tasks. Row
    numbers order by file and place within it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    placed = lines.withColumn("id", F.monotonically_increasing_id()).filter(F.trim("value") != "")

    def parse(frames):
        for frame in frames:
            rows = [_feature(json.loads(t)) for t in frame["value"]]
            out = pd.DataFrame(rows, columns=["feature_id", "geometry", "properties"])
            for k in ("id", "block", "path"):
                out.insert(0, k, frame[k].to_numpy())
            yield out

    schema = "path string, block long, id long, feature_id string, geometry binary, properties string"
    parsed = placed.mapInPandas(parse, schema)
    blocks = parsed.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = blocks.select("path", "block", (F.sum("n").over(Window.orderBy("path", "block")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("path", "block").orderBy("id")) - 1
    numbered = parsed.withColumn("place", place).join(before, ["path", "block"])
    return numbered.select((F.col("before") + F.col("place")).alias("row_number"), "feature_id", "geometry", "properties")


def to_feature_collection(rows: Sequence[dict]) -> dict:
    return {"type": "FeatureCollection", "features": list(rows)}


# -- GeoParquet ----------------------------------------------------------------


@dataclass(frozen=True)
class GeometryColumn:
    name: str
    encoding: str
    geometry_types: tuple[str, ...] = ()
    crs: str | None = None
    edges: str = "planar"
    covering: dict[str, tuple[str, ...]] | None = None
    native: bool = False
    usable: bool = True


@dataclass(frozen=True)
class GroupBounds:
    """What a footer says of a native column in one row group; no bounds where
    it says nothing. West exceeds east if the group crosses the antimeridian."""

    column: str
    row_group: int
    rows: int
    bounds: tuple[float, float, float, float] | None = None
    heights: tuple[float, float] | None = None
    kinds: tuple[int, ...] = ()

    @property
    def crossing(self) -> bool:
        return self.bounds is not None and self.bounds[0] > self.bounds[2]


@dataclass(frozen=True)
class Discovery:
    columns: tuple[GeometryColumn, ...]
    primary: str | None
    rows: int
    row_groups: int
    schema: tuple[tuple[str, str], ...]
    warnings: tuple[str, ...] = field(default=())
    groups: tuple[GroupBounds, ...] = field(default=())

    def select(self, name: str | None = None) -> GeometryColumn:
        """By name, else the primary column, else the only native one."""
        usable = {c.name: c for c in self.columns if c.usable}
        if name is not None:
            if name not in usable:
                raise FeatureError(f"no usable geometry column {name}")
            return usable[name]
        if self.primary is not None:
            if self.primary not in usable:
                raise FeatureError(f"the primary column {self.primary} is not usable")
            return usable[self.primary]
        native = [c for c in usable.values() if c.native]
        if len(native) != 1:
            raise AmbiguousGeometry("several geometry columns" if native else "no geometry column")
        return native[0]

    def fingerprint(self) -> str:
        """Changes with the number of rows or the columns."""
        text = json.dumps([self.rows, self.schema])
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()[:32]


ENCODINGS = {"WKB", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon"}


def discover(path: str) -> Discovery:
    """From the footer of one Parquet file that this process can open."""
    import pyarrow.parquet as pq

    meta = pq.read_metadata(path.removeprefix("file://"))
    raw = (meta.metadata or {}).get(b"geo")
    geo = json.loads(raw) if raw else {}
    columns, warnings = [], []
    schema = meta.schema.to_arrow_schema()
    for name, c in geo.get("columns", {}).items():
        usable = name in schema.names and c.get("encoding") in ENCODINGS
        if not usable:
            warnings.append(f"column {name} is missing or has an unknown encoding")
        box = (c.get("covering") or {}).get("bbox")
        crs = c.get("crs")
        columns.append(
            GeometryColumn(
                name, c.get("encoding", ""), tuple(c.get("geometry_types", ())), json.dumps(crs) if isinstance(crs, dict) else crs,
                c.get("edges", "planar"), {k: tuple(v) for k, v in box.items()} if box else None, usable=usable,
            )
        )
    groups: list[GroupBounds] = []
    for k in range(len(meta.schema)):
        kind = str(meta.schema.column(k).logical_type)
        name = meta.schema.column(k).path
        if kind.upper().startswith(("GEOMETRY", "GEOGRAPHY")) and name not in geo.get("columns", {}):
            edges = "spherical" if kind.upper().startswith("GEOGRAPHY") else "planar"
            columns.append(GeometryColumn(name, "WKB", edges=edges, native=True))
            groups += _group_bounds(meta, k)
    fields = tuple((f.name, str(f.type)) for f in schema)
    return Discovery(tuple(columns), geo.get("primary_column"), meta.num_rows, meta.num_row_groups, fields, tuple(warnings), tuple(groups))


def _group_bounds(meta, k: int) -> list[GroupBounds]:
    """Geospatial statistics of leaf column `k`, a row group each."""
    found = []
    for g in range(meta.num_row_groups):
        chunk, rows = meta.row_group(g).column(k), meta.row_group(g).num_rows
        # Readers older than these statistics don't know them.
        own = chunk.geo_statistics if getattr(chunk, "is_geo_stats_set", False) else None
        box = None if own is None else (own.xmin, own.ymin, own.xmax, own.ymax)
        if box is None or None in box:
            found.append(GroupBounds(chunk.path_in_schema, g, rows))
        else:
            heights = None if own.zmin is None else (own.zmin, own.zmax)
            found.append(GroupBounds(chunk.path_in_schema, g, rows, box, heights, tuple(own.geospatial_types or ())))
    return found


def discover_features(features: DataFrame) -> Discovery:
    """Of features in a source without metadata, by one pass over them."""
    from .inspect import exact_profile

    profile = exact_profile(features)
    kinds = tuple(k + " Z" * ("z" in profile.dims) for k in profile.kinds)
    keys = features.select(F.explode(F.json_object_keys("properties")).alias("k")).distinct().orderBy("k").collect()  # the schema, not the data
    schema = (("geometry", "geometry"), *((r.k, "json") for r in keys))
    return Discovery((GeometryColumn("geometry", "WKB", kinds, "OGC:CRS84"),), "geometry", profile.rows, 1, schema)


def geo_metadata(column: str = "geometry", encoding: str = "WKB", types: Sequence[str] = (), covering: dict | None = None, **more) -> bytes:
    """The file metadata value of a GeoParquet file with one geometry column."""
    own = {"encoding": encoding, "geometry_types": list(types), **({"covering": {"bbox": covering}} if covering else {}), **more}
    return json.dumps({"version": "1.1.0", "primary_column": column, "columns": {column: own}}).encode()


def read_parquet_features(spark: SparkSession, path: str, column: str = "geometry", properties: Sequence[str] | None = None, covering: dict | None = None, encoding: str = "WKB") -> DataFrame:
    """Geometries in a GeoArrow `encoding` come out as WKB. Row numbers are the reader's own for each file, after the files before;
    only the columns asked for are read. With the file's `covering` (discover()
    tells it) bounds come from its columns, and plans without bodies never read
    a geometry; whether there is a Z is then what the covering says."""
    table = spark.read.parquet(path)
    names = [c for c in table.columns if c != column] if properties is None else list(properties)
    missing = [c for c in names if c not in table.columns]
    if missing:
        raise FeatureError(f"no such properties: {missing}")
    rows = table.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"),
        F.lit(None).cast("string").alias("feature_id"), (F.col(column) if encoding == "WKB" else geoarrow_geometry(table, column, encoding)).alias("geometry"),
        (F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("{}")).alias("properties"),
        *([_measured_by(covering)] if covering else []),
    )
    counts = table.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before) if counts.limit(10_001).count() <= 10_000 else before, "path").select(
        (F.col("before") + F.col("place")).alias("row_number"), "feature_id", "geometry", "properties", *(["__bounds"] if covering else [])
    )


def _measured_by(covering: dict[str, Sequence[str]]) -> Column:
    """The covering in the form of `wkb.BOUNDS`; no bounds mean no geometry."""
    own, none, z = covering_bounds(covering), F.lit(None).cast("double"), "zmin" in covering
    fields = [own.get(n, none).alias(n) for n in ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")]
    kind = F.when(own["min_x"].isNotNull(), F.lit("Geometry"))
    more = [own["min_x"].alias("west"), own["max_x"].alias("east"), kind.alias("kind"), F.lit(z).alias("has_z"), F.lit(False).alias("has_m")]
    return F.struct(*fields, *more).alias("__bounds")


def covering_bounds(covering: dict[str, Sequence[str]]) -> dict[str, Column]:
    """Bounds from a file's covering columns: geometry bytes stay unread."""
    names = {"xmin": "min_x", "ymin": "min_y", "zmin": "min_z", "xmax": "max_x", "ymax": "max_y", "zmax": "max_z"}
    return {names[k]: F.col(".".join(v)).cast("double") for k, v in covering.items() if k in names}


# -- GeoArrow ------------------------------------------------------------------

DEPTH = {"point": 0, "linestring": 1, "multipoint": 1, "polygon": 2, "multilinestring": 2, "multipolygon": 3}


def geoarrow_bounds(column: str, encoding: str, has_z: bool = False) -> dict[str, Column]:
    """Bounds of coordinates in structs (x, y[, z]), nested in lists as the
    encoding has it, by array functions alone; null coordinates are skipped."""
    axes = "xyz" if has_z else "xy"
    if DEPTH[encoding] == 0:
        return {f"{side}_{a}": F.col(f"{column}.{a}") for side in ("min", "max") for a in axes}
    flat = F.col(column)
    for _ in range(DEPTH[encoding] - 1):
        flat = F.flatten(F.filter(flat, lambda x: x.isNotNull()))
    flat = F.filter(flat, lambda p: p.isNotNull())

    def along(axis: str) -> Column:
        return F.transform(flat, lambda p: p[axis])

    low = {f"min_{a}": F.array_min(along(a)) for a in axes}
    return low | {f"max_{a}": F.array_max(along(a)) for a in axes}


# Names of GeoArrow encodings and of the geometries they hold.
GEOARROW_KINDS = {
    "point": "Point", "linestring": "LineString", "polygon": "Polygon",
    "multipoint": "MultiPoint", "multilinestring": "MultiLineString", "multipolygon": "MultiPolygon",
}


def _shape(kind: str, value, size: int) -> wkb.Geometry:
    """A geometry of nested lists of positions; null positions are left out."""
    z = size > 2
    if kind == "Point":
        return wkb.Geometry(kind, z, False, np.array([value], np.float64).reshape(-1, size))
    if kind.startswith("Multi"):
        return wkb.Geometry(kind, z, False, None, [_shape(kind[5:], v, size) for v in value if v is not None])
    if kind == "Polygon":
        return wkb.Geometry(kind, z, False, [_shape("LineString", r, size).coordinates for r in value if r is not None])
    rows = [p for p in value if p is not None]
    return wkb.Geometry(kind, z, False, np.array([list(p) for p in rows], np.float64).reshape(-1, size))


def geoarrow_geometry(table: DataFrame, column: str, encoding: str) -> Column:
    """WKB of a GeoArrow column, whose positions are structs (x, y[, z]) or
    lists of two or three numbers. A null geometry, a point without x or y and
    a list of points that are all null hold no coordinates: null or empty."""
    kind, depth = GEOARROW_KINDS[encoding], DEPTH[encoding]
    leaf = table.schema[column].dataType
    for _ in range(depth):
        leaf = leaf.elementType
    axes = [a for a in "xyz" if a in leaf.names] if isinstance(leaf, T.StructType) else None

    def positions(value: Column, level: int) -> Column:
        if level:
            return F.transform(value, lambda v: positions(v, level - 1))
        if axes is None:
            return F.when(F.size(value) > 1, F.slice(value, 1, 3))
        own = F.array(*[value[a].cast("double") for a in axes])
        return F.when(value["x"].isNotNull() & value["y"].isNotNull(), own)

    def first(value):
        """The first position there is, to tell whether it has a z."""
        if value is None or not len(value):
            return None
        if not hasattr(value[0], "__len__") and value[0] is not None:
            return value
        return next((f for f in map(first, value) if f is not None), None)

    @F.pandas_udf(T.BinaryType())
    def encode(values: pd.Series) -> pd.Series:
        found = []
        for v in values:
            place = first(v)
            size = 2 if place is None else len(place)
            found.append(None if v is None or kind == "Point" and place is None else wkb.encode(_shape(kind, v, size)))
        return pd.Series(found, dtype=object)

    return encode(positions(F.col(column), depth))
