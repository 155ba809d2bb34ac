"""Spatial datasets built from features: convert, open, search, page, read back.

An artifact is a folder: `entries`, a Parquet table clustered along a Hilbert
curve with one row for each entry, and `manifest`, one JSON line about it. What
a payload plan leaves out isn't stored; what a search doesn't ask for isn't
read, since columns lie apart.

Rows of entries: entry_id, bounds, row_number, part, feature_id, and by the
payload plan geometry (WKB) and properties (JSON).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import box, box_names, overlaps
from tessera.functions.geodesy import radius_boxes
from tessera.functions.rays import Ray
from tessera.functions.regions import Region
from tessera.operators.envelope import MEASURED, measured, scan_envelopes
from tessera.operators.exact import Area, RectanglesMeet, check_planar, intersects, is_projected, within_radius
from tessera.operators.frame import SpatialFrame
from tessera.sources.records import project_properties

from .staging import discard, workspace

PLANS = ("none", "row-ref", "row-wkb", "feature-json")
BODIES = {"row-wkb": ["geometry"], "feature-json": ["geometry", "properties"]}
#: Canonical order of entries; missing parts and ids come first.
ORDER = ("row_number", "feature_id", "part", "entry_id")
SCHEMA_VERSION = 1


class ArtifactError(ValueError):
    code = "invalid_artifact"


class UnsupportedArtifact(ArtifactError):
    code = "unsupported_artifact"


class StaleReference(ArtifactError):
    code = "stale_reference"


@dataclass(frozen=True)
class Manifest:
    schema_version: int
    dims: int
    precision: str
    payload: str
    items: int
    features: int
    extent: tuple[float, ...] | None
    stores_feature_ids: bool
    entries_may_duplicate_rows: bool
    envelope_policy: str
    null_policy: str
    edges: str = "planar"
    crs: str | None = None
    source_fingerprint: str | None = None
    content_type: str | None = None
    attribution: str | None = None


# -- queries as values ---------------------------------------------------------


@dataclass(frozen=True)
class Query:
    """kind: box (4 numbers), box3d (6), polygon (rings), multi_polygon (lists of
    rings), radius (lon, lat, metres)."""

    kind: str
    value: tuple

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "value": self.value})

    @classmethod
    def from_json(cls, text: str) -> Query:
        found = json.loads(text)
        if set(found) != {"kind", "value"} or found["kind"] not in ("box", "box3d", "polygon", "multi_polygon", "radius"):
            raise ArtifactError(f"not a query: {text}")
        freeze = lambda v: tuple(map(freeze, v)) if isinstance(v, list) else v
        return cls(found["kind"], freeze(found["value"]))

    def area(self) -> Area:
        if self.kind == "box":
            return Area.box(*self.value)
        if self.kind == "polygon":
            return Area([self.value])
        if self.kind == "multi_polygon":
            return Area(self.value)
        raise UnsupportedArtifact(f"{self.kind} has no planar area")

    def candidate_boxes(self) -> list[tuple[float, ...]]:
        if self.kind in ("box", "box3d"):
            return [tuple(self.value)]
        if self.kind == "radius":
            return radius_boxes(*self.value)
        bounds = self.area().bounds
        return [] if bounds is None else [tuple(map(float, bounds))]


def candidates(frame: SpatialFrame, query: Query | Region, mode: str = "region") -> Column:
    """Which entries a query's search returns. Polygons test each stored box
    ("region"), or only their own bounding box ("bbox")."""
    own = frame.box
    if not isinstance(query, Query):
        return query.overlaps_box(own)
    boxes = [overlaps(own, box(*b)) for b in query.candidate_boxes()]
    found = reduce(lambda a, b: a | b, boxes) if boxes else F.lit(False)
    if mode == "region" and query.kind in ("polygon", "multi_polygon"):
        found = found & RectanglesMeet(query.area()).overlaps_box(own)
    return found


# -- writing -------------------------------------------------------------------


def index_features(
    features: DataFrame, payload: str = "row-wkb", nulls: str = "skip", policy: str = "planar", dims: str = "auto"
) -> DataFrame:
    """Entries of features, not stored: what an artifact holds."""
    if payload not in PLANS:
        raise ArtifactError(f"unknown payload plan {payload}")
    entries = scan_envelopes(features, nulls, policy, dims)
    refs = [] if payload == "none" else ["row_number", "part", "feature_id"]
    body = BODIES.get(payload, [])
    own_dims = 3 if "min_z" in entries.columns else 2
    by_row = F.xxhash64("row_number", F.coalesce("part", F.lit(-1)))
    # Ids are dense and follow the source: counts of buckets, then places in them.
    bucketed = entries.withColumn("__bucket", F.floor(F.col("row_number") / 65536).cast("long"))
    sums = bucketed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("__bucket", (F.sum("n").over(Window.orderBy("__bucket")) - F.col("n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("row_number", F.coalesce("part", F.lit(-1)), by_row)) - 1
    numbered = bucketed.withColumn("__place", place).join(before, "__bucket")
    return numbered.select((F.col("__before") + F.col("__place")).alias("entry_id"), *box_names(own_dims), *refs, *body)


def convert(
    features: DataFrame, path: str, payload: str = "row-wkb", nulls: str = "skip", policy: str = "planar", dims: str = "auto",
    precision: str = "f64", rows_per_file: int | None = None, edges: str = "planar", crs: str | None = None,
    fingerprint: str | None = None, content_type: str | None = None, attribution: str | None = None,
    properties: str = "all", names: Sequence[str] = (),
) -> Artifact:
    """Writes the artifact; `properties` and `names` are a projection of the features' properties. Geometries are decoded once: features are stored with their bounds first, and what
    counts, sorts and writes the entries reads those."""
    spark = features.sparkSession
    shelf = workspace(spark, "features")
    wanted = ["row_number", "feature_id", MEASURED, *BODIES.get(payload, [])]
    if "properties" in wanted:
        features = project_properties(features, properties, names)
    measured(features).select(*wanted).write.parquet(shelf)
    features = spark.read.parquet(shelf)
    entries = index_features(features, payload, nulls, policy, dims)
    own_dims = 3 if "min_z" in entries.columns else 2
    frame = SpatialFrame.build(entries, own_dims, "entry_id")
    if precision == "f32":
        frame = frame.to_single()
    elif precision != "f64":
        raise ArtifactError(f"unknown precision {precision}")
    frame.write(f"{path}/entries", rows_per_file)
    discard(spark, shelf)
    stored = SpatialFrame.read(spark, f"{path}/entries", own_dims, "entry_id")
    refs = payload != "none"
    sums = stored.df.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_distinct("row_number") if refs else F.count(F.lit(1))).alias("features"),
        (F.coalesce(F.bool_or(F.col("feature_id").isNotNull()), F.lit(False)) if refs else F.lit(False)).alias("ids"),
    ).first()
    manifest = Manifest(
        SCHEMA_VERSION, own_dims, precision, payload, sums.n, sums.features, stored.extent(), sums.ids, sums.n > sums.features,
        policy, nulls, edges, crs, fingerprint, content_type, attribution,
    )
    spark.createDataFrame([(json.dumps(asdict(manifest)),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return Artifact(stored, manifest)


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    found = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if found.get("schema_version") != SCHEMA_VERSION or set(found) != set(Manifest.__dataclass_fields__):
        raise ArtifactError("not a manifest of this version")
    return Manifest(**found | {"extent": None if found["extent"] is None else tuple(found["extent"])})


def open_artifact(spark: SparkSession, path: str) -> Artifact:
    manifest = read_manifest(spark, path)
    return Artifact(SpatialFrame.read(spark, f"{path}/entries", manifest.dims, "entry_id"), manifest)


# -- reading -------------------------------------------------------------------


def dedupe_features(entries: DataFrame) -> DataFrame:
    """One entry for each feature, the lowest part; its part is no longer one
    feature's and becomes null. To be done after any exact filter."""
    first = F.row_number().over(Window.partitionBy("row_number", "feature_id").orderBy(F.col("part").asc_nulls_first(), "entry_id"))
    return entries.withColumn("__n", first).filter("__n = 1").drop("__n").withColumn("part", F.lit(None).cast("int"))


class Artifact:
    def __init__(self, frame: SpatialFrame, manifest: Manifest):
        self.frame, self.manifest = frame, manifest

    def _needs_refs(self) -> None:
        if self.manifest.payload == "none":
            raise UnsupportedArtifact("the artifact has no feature references")

    def _found(self, query: Query | Region, mode: str = "region") -> DataFrame:
        single = self.manifest.precision == "f32"
        if single and not (isinstance(query, Query) and query.kind in ("box", "box3d")):
            raise UnsupportedArtifact("single-precision artifacts answer boxes only")
        if isinstance(query, Query) and query.kind == "radius" and is_projected(self.manifest.crs):
            raise UnsupportedArtifact("a radius needs degrees, the coordinates are projected")
        if single:
            return self.frame.search_single(*query.value)
        return self.frame.df.filter(candidates(self.frame, query, mode))

    def entry_ids(self, query: Query | Region) -> DataFrame:
        return self._found(query).select("entry_id")

    def count_entries(self, query: Query | Region) -> int:
        return self._found(query).count()

    def feature_refs(self, query: Query | Region, mode: str = "region") -> DataFrame:
        self._needs_refs()
        return self._found(query, mode).select("entry_id", "row_number", "part", "feature_id")

    def matches(self, query: Query | Region) -> DataFrame:
        """Full rows in canonical order."""
        self._needs_refs()
        return self._found(query).orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])

    def features(self, query: Query | Region) -> DataFrame:
        self._needs_refs()
        return dedupe_features(self._found(query)).orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])

    def headers(self, query: Query | Region) -> DataFrame:
        """References and payload lengths; bodies aren't returned."""
        self._needs_refs()
        length = F.octet_length("geometry").cast("long") if "geometry" in self.frame.df.columns else F.lit(0).cast("long")
        found = self._found(query).select("entry_id", "row_number", "part", "feature_id", length.alias("payload_len"))
        return found.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])

    def header_page(self, query: Query | Region, offset: int, limit: int) -> tuple[int, DataFrame]:
        """(number matched, the page): a bounded top-k, never a full sort of bodies."""
        return self.count_entries(query), self.headers(query).offset(offset).limit(limit)

    def fetch(self, headers: DataFrame) -> DataFrame:
        """Bodies of headers, in their order; a header that isn't there is an error."""
        wanted = headers.select("entry_id", F.monotonically_increasing_id().alias("__at"), F.col("row_number").alias("__row"))
        got = wanted.join(self.frame.df, "entry_id", "left").withColumn(
            "row_number",
            F.when(F.col("row_number").eqNullSafe(F.col("__row")), F.col("row_number")).otherwise(F.raise_error(F.lit("a header is stale")).cast("long")),
        )
        return got.orderBy("__at").drop("__at", "__row")

    def exact(self, query: Query, treat_as_planar: bool = False) -> DataFrame:
        """Matches whose stored geometry meets the query."""
        if "geometry" not in self.frame.df.columns:
            raise UnsupportedArtifact("the artifact stores no geometry")
        found = self._found(query, "bbox")
        if query.kind == "radius":
            return found.filter(within_radius(F.col("geometry"), *query.value))
        if query.kind == "box3d":
            raise UnsupportedArtifact("there is no exact test in 3D")
        check_planar(self.manifest.edges, treat_as_planar)
        return found.filter(intersects(F.col("geometry"), query.area()))

    def payload_headers(self, query: Query | Region) -> DataFrame:
        """Ids and lengths of stored bodies, by id; no reference is read, so any payload plan will do."""
        stored = [c for c in ("geometry", "properties") if c in self.frame.df.columns]
        length = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in stored), F.lit(0).cast("long"))
        return self._found(query).select("entry_id", length.alias("payload_len")).orderBy("entry_id")

    def payload_header_page(self, query: Query | Region, offset: int, limit: int) -> tuple[int, DataFrame]:
        return self.count_entries(query), self.payload_headers(query).offset(offset).limit(limit)

    def _ray(self, ray: Ray) -> DataFrame:
        self._needs_refs()
        if len(ray.origin) != self.manifest.dims:
            raise UnsupportedArtifact(f"the artifact has {self.manifest.dims} dimensions")
        return self.frame.raycast(ray).select("entry_id", "row_number", "part", "feature_id", "t")

    def raycast(self, ray: Ray) -> DataFrame:
        """References of the entries that a ray meets, with t; single-precision boxes may add some."""
        return self._ray(ray)

    def raycast_closest(self, ray: Ray) -> DataFrame:
        """The entry met first, of equal t the one with the smaller id; needs double precision."""
        if self.manifest.precision == "f32":
            raise UnsupportedArtifact("rounded boxes don't tell which is met first")
        best = self._ray(ray).agg(F.min(F.struct("t", "entry_id", "row_number", "part", "feature_id")).alias("m"))
        return best.filter("m IS NOT NULL").select("m.entry_id", "m.row_number", "m.part", "m.feature_id", "m.t")

    def nearest(self, point: tuple[float, ...], k: int) -> DataFrame:
        self._needs_refs()
        return self.frame.neighbors(point, k).select("entry_id", "row_number", "part", "feature_id", "distance_squared")

    def nearest_on_sphere(self, lon: float, lat: float, k: int, metres: float | None = None) -> DataFrame:
        from tessera.functions.geodesy import haversine_to_box

        self._needs_refs()
        if self.manifest.dims != 2 or self.manifest.precision != "f64":
            raise UnsupportedArtifact("great-circle search needs 2D and double precision")
        found = self.frame.neighbors_metric(lambda b: haversine_to_box(lon, lat, b), k, metres)
        return found.select("entry_id", "row_number", "part", "feature_id", "distance")


def read_back(
    refs: DataFrame, source: DataFrame, order: str = "request", duplicates: str = "dedup", fingerprints: tuple[str | None, str | None] = (None, None)
) -> DataFrame:
    """Source rows of references (row_number, part, and `position`, their place in
    the request). order: "request" or "source". duplicates: "dedup" keeps a
    row's first reference, "keep" all. A row that the source lacks is an error."""
    if order not in ("request", "source") or duplicates not in ("dedup", "keep"):
        raise ArtifactError(f"unknown option: {order}, {duplicates}")
    stored, now = fingerprints
    if stored is not None and stored != now:
        raise StaleReference("the source has changed since the artifact was built")
    wanted = refs.select("row_number", "part", "position")
    if duplicates == "dedup":
        first = F.row_number().over(Window.partitionBy("row_number").orderBy("position"))
        wanted = wanted.withColumn("__n", first).filter("__n = 1").drop("__n")
    there = source.withColumn("__there", F.lit(True))
    got = wanted.join(there, "row_number", "left").withColumn(
        "position", F.when(F.col("__there"), F.col("position")).otherwise(F.raise_error(F.lit("a row is not in the source")).cast("long"))
    )
    keys = ["position"] if order == "request" else ["row_number", F.col("part").asc_nulls_first(), "position"]
    return got.drop("__there").orderBy(*keys)
