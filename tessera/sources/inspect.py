"""Profiles and validation of feature sources before anything is built."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import AmbiguousGeometry, Discovery, FeatureError, GeometryColumn
from .wkb import wkb_bounds

# The codes that issues carry.
CODES = (
    "no_geometry_columns", "ambiguous_geometry_column", "geometry_column_not_found", "unsupported_encoding", "cannot_scan_envelopes",
    "cannot_emit_payload", "unknown_dimensions", "covering_missing_z", "missing_native_geo_stats", "antimeridian_wrap",
    "geography_coordinate_aabb", "exact_scan_failed", "projected_property_missing",
)


@dataclass(frozen=True)
class Issue:
    severity: str
    code: str
    message: str
    column: str | None = None


@dataclass(frozen=True)
class Profile:
    rows: int | None
    kinds: tuple[str, ...]
    dims: str
    bounds: tuple[float, ...] | None
    crossing: int | None
    exact: bool


@dataclass(frozen=True)
class Report:
    selected: GeometryColumn | None
    profile: Profile | None
    issues: tuple[Issue, ...] = field(default=())

    @property
    def ok(self) -> bool:
        return all(i.severity != "error" for i in self.issues)


def declared_profile(column: GeometryColumn) -> Profile:
    z = any(" Z" in t for t in column.geometry_types)
    dims = "unknown" if not column.geometry_types else "xyz" if z else "xy"
    return Profile(None, tuple(t.replace(" Z", "") for t in column.geometry_types), dims, None, None, False)


def exact_profile(features: DataFrame) -> Profile:
    """One pass over the geometries: kinds, dimensions, bounds, crossings."""
    b = features.select(wkb_bounds("geometry").alias("b"))
    r = b.agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("b.kind")).alias("kinds"), F.bool_or("b.has_z").alias("z"), F.bool_or("b.has_m").alias("m"),
        F.min("b.min_x").alias("x0"), F.min("b.min_y").alias("y0"), F.max("b.max_x").alias("x1"), F.max("b.max_y").alias("y1"),
        F.count_if(F.col("b.west") > F.col("b.east")).alias("crossing"),
    ).first()
    bounds = None if r.x0 is None else (r.x0, r.y0, r.x1, r.y1)
    return Profile(r.n, tuple(r.kinds), "xy" + "z" * bool(r.z) + "m" * bool(r.m), bounds, r.crossing, True)


def validate(
    discovery: Discovery, features: DataFrame | None = None, column: str | None = None, payload: str = "none", properties: tuple[str, ...] = ()
) -> Report:
    """Issues of building an index over a source; `features` allows the exact scan."""
    issues: list[Issue] = []
    add = lambda severity, code, message, name=None: issues.append(Issue(severity, code, message, name))
    if not discovery.columns:
        add("error", "no_geometry_columns", "the source has no geometry column")
        return Report(None, None, tuple(issues))
    for c in discovery.columns:
        if not c.usable:
            add("warning", "unsupported_encoding", f"encoding {c.encoding!r} can't be read", c.name)
    try:
        chosen = discovery.select(column)
    except AmbiguousGeometry as e:
        add("error", "ambiguous_geometry_column", str(e))
        return Report(None, None, tuple(issues))
    except FeatureError as e:
        add("error", "geometry_column_not_found", str(e), column)
        return Report(None, None, tuple(issues))
    profile = declared_profile(chosen)
    if profile.dims == "unknown":
        add("warning", "unknown_dimensions", "the metadata names no geometry types", chosen.name)
    if profile.dims == "xyz" and chosen.covering and "zmin" not in chosen.covering:
        add("warning", "covering_missing_z", "the covering has no z, so boxes from it are 2D", chosen.name)
    if chosen.edges != "planar":
        add("warning", "geography_coordinate_aabb", "edges on a sphere are indexed by their coordinates", chosen.name)
    if chosen.native:
        groups = [g for g in discovery.groups if g.column == chosen.name]
        if not groups or any(g.bounds is None for g in groups):
            add("info", "missing_native_geo_stats", "row groups lack geospatial statistics", chosen.name)
        if crossing := [g.row_group for g in groups if g.crossing]:
            add("warning", "antimeridian_wrap", f"row groups that cross the antimeridian: {len(crossing)}, the first is {crossing[0]}", chosen.name)
    if payload in ("row-wkb", "feature-json") and chosen.encoding != "WKB":
        add("error", "cannot_emit_payload", f"{payload} needs WKB, the column is {chosen.encoding}", chosen.name)
    names = {n for n, _ in discovery.schema}
    for p in properties:
        if p not in names:
            add("error", "projected_property_missing", f"no column {p}", p)
    if features is not None:
        try:
            profile = exact_profile(features)
            if profile.crossing:
                add("warning", "antimeridian_wrap", f"{profile.crossing} geometries cross the antimeridian", chosen.name)
        except Exception as e:
            add("error", "exact_scan_failed", str(e).splitlines()[0][:200], chosen.name)
    return Report(chosen, profile, tuple(issues))
