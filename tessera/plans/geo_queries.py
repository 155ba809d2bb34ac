"""Registered queries of the geographic pipeline, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.boxes import box_names
from tessera.functions.rays import Ray
from tessera.operators.envelope import scan_envelopes
from tessera.operators.exact import Area, intersects, within_radius
from tessera.sources.features import read_geojson_lines, read_parquet_features
from tessera.sources.wkb import wkb_bounds, wkb_point, wkb_segment, wkb_to_json
from tessera.streaming.points import locate_stream

from . import service
from .artifact import Query, convert, index_features, open_artifact, read_back
from .core_queries import _slab_sql
from .staging import workspace
from .tables import derived, derived_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def points(spark, sf) -> DataFrame:
    places = derived(spark, sf, "places")
    return places.select(
        F.col("item_id").alias("row_number"), F.col("name").alias("feature_id"), wkb_point("lon", "lat").alias("geometry"),
        F.to_json(F.struct("name", "segment")).alias("properties"),
    )


def lines(spark, sf) -> DataFrame:
    """From each place up to 39 degrees east, over the antimeridian too."""
    east = F.col("lon") + F.col("item_id") % 40
    ends = derived(spark, sf, "places").filter("lat <= 89").withColumn("east", F.when(east > 180, east - 360).otherwise(east))
    return ends.select(
        F.col("item_id").alias("row_number"), F.lit(None).cast("string").alias("feature_id"),
        wkb_segment("lon", "lat", "east", F.col("lat") + 1).alias("geometry"),
    )


PLACES = derived_sql("places")
LINES = PLACES + """, line AS (
  SELECT item_id AS row_number, lon, lat, CASE WHEN lon + item_id % 40 > 180 THEN lon + item_id % 40 - 360 ELSE lon + item_id % 40 END AS east FROM places WHERE lat <= 89
), crossing AS (
  SELECT *, abs(east - lon) > 180 AS over, least(lon, east) AS w, greatest(lon, east) AS e FROM line
)"""
SPLIT = LINES + """, entry AS (
  SELECT row_number, CASE WHEN over THEN e ELSE w END AS min_x, lat AS min_y, CASE WHEN over THEN 180.0 ELSE e END AS max_x, lat + 1 AS max_y, CASE WHEN over THEN 0 END AS part FROM crossing
  UNION ALL SELECT row_number, -180.0, lat, w, lat + 1, 1 FROM crossing WHERE over
)"""
WINDOW = "min_x <= 179 AND max_x >= 100 AND min_y <= 30 AND max_y >= -30"
BOX = Query("box", (100.0, -30.0, 179.0, 30.0))
ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("min_x", "min_y", "max_x", "max_y"))


def _part():
    """No part is written as -1, which engines compare alike."""
    return F.coalesce(F.col("part"), F.lit(-1)).alias("part")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in box_names(2)})


@query(f"{LINES} SELECT row_number, round(w, 6) AS min_x, round(lat, 6) AS min_y, round(e, 6) AS max_x, round(lat + 1, 6) AS max_y FROM crossing")
def geo_scan_planar(spark, sf):
    return _rounded(scan_envelopes(lines(spark, sf)).select("row_number", *box_names(2)))


@query(f"{SPLIT} SELECT row_number, coalesce(part, -1)::INTEGER AS part, {ROUND} FROM entry")
def geo_scan_split(spark, sf):
    return _rounded(scan_envelopes(lines(spark, sf), policy="split").select("row_number", _part(), *box_names(2)))


@query(f"{LINES} SELECT row_number, round(CASE WHEN over THEN -180 ELSE w END, 6) AS min_x, round(CASE WHEN over THEN 180 ELSE e END, 6) AS max_x FROM crossing")
def geo_scan_expand(spark, sf):
    return scan_envelopes(lines(spark, sf), policy="expand").select("row_number", F.round("min_x", 6).alias("min_x"), F.round("max_x", 6).alias("max_x"))


@query(f"{PLACES} SELECT item_id AS row_number, round(lon, 6) AS lon, round(lat, 6) AS lat, 'Point' AS kind FROM places")
def wkb_bounds_of_points(spark, sf):
    b = points(spark, sf).select("row_number", wkb_bounds("geometry").alias("b"))
    return b.select("row_number", F.round("b.min_x", 6).alias("lon"), F.round("b.max_y", 6).alias("lat"), F.col("b.kind").alias("kind"))


@query(f"{PLACES} SELECT item_id AS row_number, 'Point' AS kind, round(lon, 6) AS lon, round(lat, 6) AS lat FROM places")
def wkb_to_geojson(spark, sf):
    shape = "type string, coordinates array<double>"
    g = points(spark, sf).select("row_number", F.from_json(wkb_to_json("geometry"), shape).alias("g"))
    return g.select("row_number", F.col("g.type").alias("kind"), F.round(F.col("g.coordinates")[0], 6).alias("lon"), F.round(F.col("g.coordinates")[1], 6).alias("lat"))


def _artifact(spark, features: DataFrame, **options):
    path = workspace(spark, "artifact")
    convert(features, path, **options)
    return open_artifact(spark, path)


@query(f"{SPLIT} SELECT row_number, coalesce(part, -1)::INTEGER AS part FROM entry WHERE {WINDOW}")
def geo_search_refs(spark, sf):
    return _artifact(spark, lines(spark, sf), payload="row-ref", policy="split").feature_refs(BOX).select("row_number", _part())


@query(f"{SPLIT}, d AS (SELECT row_number, coalesce(part, -1) AS p FROM entry WHERE min_x <= 180 AND max_x >= -180 AND min_y <= 30 AND max_y >= -30) SELECT row_number, (-1)::INTEGER AS part, count(*) > 0 AS found FROM d GROUP BY row_number")
def geo_search_features(spark, sf):
    """Split features meet a world-wide band in two entries, but are one feature."""
    found = _artifact(spark, lines(spark, sf), policy="split").features(Query("box", (-180.0, -30.0, 180.0, 30.0)))
    return found.select("row_number", _part(), F.lit(True).alias("found"))


@query(f"{SPLIT} SELECT count(*)::BIGINT AS entries, count(DISTINCT row_number)::BIGINT AS features, count(*) > count(DISTINCT row_number) AS may_duplicate, count(*) FILTER ({WINDOW})::BIGINT AS matched FROM entry")
def geo_counts(spark, sf):
    artifact = _artifact(spark, lines(spark, sf), policy="split")
    m = artifact.manifest
    return spark.createDataFrame([(m.items, m.features, m.entries_may_duplicate_rows, artifact.count_entries(BOX))], "entries long, features long, may_duplicate boolean, matched long")


@query(f"{SPLIT} SELECT row_number, coalesce(part, -1)::INTEGER AS part, 41::BIGINT AS payload_len FROM entry WHERE {WINDOW} ORDER BY row_number, entry.part NULLS FIRST LIMIT 20 OFFSET 10")
def geo_header_page(spark, sf):
    _, page = _artifact(spark, lines(spark, sf), policy="split").header_page(BOX, 10, 20)
    return page.select("row_number", _part(), "payload_len")


@query(f"{PLACES} SELECT item_id AS row_number, name AS feature_id FROM places WHERE lon BETWEEN 100 AND 179 AND lat BETWEEN -30 AND 30 ORDER BY item_id LIMIT 15")
def geo_fetch_bodies(spark, sf):
    artifact = _artifact(spark, points(spark, sf))
    _, page = artifact.header_page(BOX, 0, 15)
    return artifact.fetch(page).select("row_number", "feature_id")


@query(f"{PLACES} SELECT item_id AS row_number FROM places WHERE lon BETWEEN 100 AND 179 AND lat BETWEEN -30 AND 30")
def geo_search_single_precision(spark, sf):
    """Candidates of rounded boxes, confirmed on the geometry."""
    artifact = _artifact(spark, points(spark, sf), precision="f32")
    return artifact.exact(BOX).select("row_number")


# A segment meets a box if its parameters inside both slabs overlap with [0, 1].
_CLIP = """, clip AS (
  SELECT row_number, lon AS x0, lat AS y0, east - lon AS dx, 1.0 AS dy FROM line
), t AS (
  SELECT row_number, dx, x0,
    CASE WHEN dx = 0 THEN 0.0 ELSE least((100 - x0) / nullif(dx, 0), (140 - x0) / nullif(dx, 0)) END AS a0, CASE WHEN dx = 0 THEN 1.0 ELSE greatest((100 - x0) / nullif(dx, 0), (140 - x0) / nullif(dx, 0)) END AS a1,
    -20 - y0 AS b0, 25 - y0 AS b1 FROM clip
)"""


@query(f"{LINES}{_CLIP} SELECT row_number FROM t WHERE greatest(a0, b0, 0) <= least(a1, b1, 1) AND (dx <> 0 OR x0 BETWEEN 100 AND 140)")
def geo_exact_box(spark, sf):
    return _artifact(spark, lines(spark, sf)).exact(Query("box", (100.0, -20.0, 140.0, 25.0))).select("row_number")


OUTER = ((-100.0, -50.0), (80.0, -60.0), (20.0, 0.0), (90.0, 55.0), (-90.0, 60.0))
HOLE = ((-50.0, -20.0), (0.0, -20.0), (0.0, 20.0), (-50.0, 20.0))


def _inside_sql(ring) -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ay != by:
            parts.append(f"CASE WHEN ({ay} > lat) <> ({by} > lat) AND lon < {ax} + (lat - ({ay})) * ({bx - ax}) / ({by - ay}) THEN 1 ELSE 0 END")
    return f"({' + '.join(parts)}) % 2 = 1"


_HOLE_OPEN = "lon > -50 AND lon < 0 AND lat > -20 AND lat < 20"


@query(f"{PLACES} SELECT item_id AS row_number FROM places WHERE {_inside_sql(OUTER)} AND NOT ({_HOLE_OPEN})")
def geo_exact_polygon(spark, sf):
    return _artifact(spark, points(spark, sf)).exact(Query("polygon", (OUTER, HOLE))).select("row_number")


@query(f"{PLACES} SELECT item_id AS row_number FROM places WHERE {_inside_sql(OUTER)} AND NOT ({_HOLE_OPEN})")
def geo_polygon_region(spark, sf):
    """The stored boxes themselves against the polygon."""
    return _artifact(spark, points(spark, sf), payload="row-ref").feature_refs(Query("polygon", (OUTER, HOLE))).select("row_number")


@query(f"{PLACES} SELECT item_id AS row_number FROM places WHERE lon BETWEEN -100 AND 90 AND lat BETWEEN -60 AND 60")
def geo_polygon_bbox(spark, sf):
    found = _artifact(spark, points(spark, sf), payload="row-ref").feature_refs(Query("polygon", (OUTER, HOLE)), mode="bbox")
    return found.select("row_number")


@query(f"{PLACES} SELECT item_id AS row_number FROM places WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - 5) / 2), 2) + cos(radians(5)) * cos(radians(lat)) * pow(sin(radians(lon - 178) / 2), 2)))) <= 2500000")
def geo_radius(spark, sf):
    return _artifact(spark, points(spark, sf)).exact(Query("radius", (178.0, 5.0, 2_500_000.0))).select("row_number")


@query(f"{PLACES} SELECT item_id AS row_number, round(pow(lon - 10, 2) + pow(lat - 20, 2), 6) AS distance_squared FROM places ORDER BY pow(lon - 10, 2) + pow(lat - 20, 2), item_id LIMIT 7")
def geo_nearest(spark, sf):
    found = _artifact(spark, points(spark, sf), payload="row-ref").nearest((10.0, 20.0), 7)
    return found.select("row_number", F.round("distance_squared", 6).alias("distance_squared"))


_METRES = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - 20) / 2), 2) + cos(radians(20)) * cos(radians(lat)) * pow(sin(radians(lon - 10) / 2), 2))))"


@query(f"{PLACES} SELECT item_id AS row_number, round({_METRES}, 3) AS distance FROM places ORDER BY {_METRES}, item_id LIMIT 7")
def geo_nearest_on_sphere(spark, sf):
    found = _artifact(spark, points(spark, sf), payload="row-ref").nearest_on_sphere(10.0, 20.0, 7)
    return found.select("row_number", F.round("distance", 3).alias("distance"))


@query(f"{PLACES} SELECT item_id AS row_number, segment FROM places WHERE lon BETWEEN 100 AND 179 AND lat BETWEEN -30 AND 30")
def geo_read_back(spark, sf):
    refs = _artifact(spark, points(spark, sf), payload="row-ref").feature_refs(BOX).withColumn("position", F.col("entry_id"))
    source = derived(spark, sf, "places").withColumnRenamed("item_id", "row_number")
    return read_back(refs, source).select("row_number", "segment")


@query(f"{PLACES} SELECT item_id AS row_number, name AS feature_id FROM places WHERE lon BETWEEN -20 AND 60 AND lat BETWEEN -30 AND 30 ORDER BY item_id LIMIT 25 OFFSET 5")
def service_search(spark, sf):
    collection = service.Collection("places", "Places", _artifact(spark, points(spark, sf), payload="feature-json"))
    _, page = service.search(collection, {"bbox": "-20,-30,60,30", "limit": "25", "offset": "5", "predicate": "intersects"})
    return page.select("row_number", "feature_id")


@query(f"{PLACES} SELECT name AS id, segment FROM places WHERE lon BETWEEN -20 AND 60 AND lat BETWEEN -30 AND 30 ORDER BY item_id LIMIT 10")
def service_items(spark, sf):
    collection = service.Collection("places", "Places", _artifact(spark, points(spark, sf), payload="feature-json"))
    found = service.items(collection, {"bbox": "-20,-30,60,30", "limit": "10"})
    return spark.createDataFrame([(f["id"], f["properties"]["segment"]) for f in found["features"]], "id string, segment string")


@query(f"{PLACES}, e AS (SELECT item_id AS row_number, (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS entry_id FROM places) SELECT * FROM e")
def geo_entry_ids(spark, sf):
    return index_features(points(spark, sf), payload="row-ref").select("row_number", "entry_id")


@query(f"{derived_sql('boxes', 'sites')} SELECT query_id, item_id AS box_id FROM sites, boxes WHERE x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y")
def points_in_boxes(spark, sf):
    return locate_stream(derived(spark, sf, "sites"), derived(spark, sf, "boxes")).select("query_id", "box_id")


@query(f"{PLACES} SELECT item_id AS row_number FROM places WHERE (lon BETWEEN 0 AND 40 AND lat BETWEEN 0 AND 40) OR (lon BETWEEN -120 AND -80 AND lat BETWEEN -40 AND 0)")
def geo_exact_multi_polygon(spark, sf):
    square = lambda x0, y0, x1, y1: [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]
    area = Area([square(0, 0, 40, 40), square(-120, -40, -80, 0)])
    return points(spark, sf).filter(intersects(F.col("geometry"), area)).select("row_number")


# -- rays, headers, three dimensions, sources --------------------------------------

_RAY = f"{SPLIT}, h AS (SELECT row_number, coalesce(part, -1)::INTEGER AS part, {_slab_sql((-180, -90), (2, 1), 2, 180)} FROM entry)"
RAY = Ray((-180.0, -90.0), (2.0, 1.0), 180.0)


@query(f"{_RAY} SELECT row_number, part, round(t, 6) AS t FROM h WHERE still AND t <= far")
def geo_raycast(spark, sf):
    found = _artifact(spark, lines(spark, sf), payload="row-ref", policy="split").raycast(RAY)
    return found.select("row_number", _part(), F.round("t", 6).alias("t"))


@query(f"{_RAY} SELECT round(min(t), 6) AS t FROM h WHERE still AND t <= far")
def geo_raycast_closest(spark, sf):
    return _artifact(spark, lines(spark, sf), payload="row-ref", policy="split").raycast_closest(RAY).select(F.round("t", 6).alias("t"))


@query(f"{PLACES}, e AS (SELECT *, (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS entry_id FROM places) SELECT entry_id, 21::BIGINT AS payload_len FROM e WHERE lon BETWEEN 100 AND 179 AND lat BETWEEN -30 AND 30 ORDER BY entry_id LIMIT 20 OFFSET 5")
def geo_payload_header_page(spark, sf):
    _, page = _artifact(spark, points(spark, sf)).payload_header_page(BOX, 5, 20)
    return page


@query(f"{PLACES} SELECT item_id AS row_number, name AS feature_id, 21::BIGINT AS bytes FROM places WHERE lon BETWEEN 100 AND 179 AND lat BETWEEN -30 AND 30")
def geo_matches(spark, sf):
    return _artifact(spark, points(spark, sf)).matches(BOX).select("row_number", "feature_id", F.octet_length("geometry").cast("long").alias("bytes"))


def _pairs(spark, sf) -> DataFrame:
    """Multipoints of a place and the place across the equator, 20 degrees east at most."""
    both = F.concat(F.unhex(F.lit("010400000002000000")), wkb_point("lon", "lat"), wkb_point(F.least(F.col("lon") + 20, F.lit(180.0)), -F.col("lat")))
    return derived(spark, sf, "places").select(F.col("item_id").alias("row_number"), both.alias("geometry"))


_PAIRS = f"{PLACES}, p AS (SELECT item_id AS row_number, lon, lat, least(lon + 20, 180) AS lon2, -lat AS lat2 FROM places)"


@query(f"{_PAIRS} SELECT row_number FROM p WHERE (lon BETWEEN 10 AND 70 AND lat BETWEEN 5 AND 45) OR (lon2 BETWEEN 10 AND 70 AND lat2 BETWEEN 5 AND 45)")
def geo_exact_multipoint(spark, sf):
    return _pairs(spark, sf).filter(intersects(F.col("geometry"), Area.box(10, 5, 70, 45))).select("row_number")


def _metres_sql(lon: str, lat: str) -> str:
    return f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({lat} - 20) / 2), 2) + cos(radians(20)) * cos(radians({lat})) * pow(sin(radians({lon} - 10) / 2), 2))))"


@query(f"{_PAIRS} SELECT row_number FROM p WHERE {_metres_sql('lon', 'lat')} <= 2000000 OR {_metres_sql('lon2', 'lat2')} <= 2000000")
def geo_radius_multipoint(spark, sf):
    return _pairs(spark, sf).filter(within_radius(F.col("geometry"), 10.0, 20.0, 2_000_000.0)).select("row_number")


def points3(spark, sf) -> DataFrame:
    """Places at heights of 0 to 999."""
    z = F.substring(wkb_point((F.col("item_id") % 1000).cast("double"), F.lit(0.0)), 6, 8)
    raw = F.concat(F.unhex(F.lit("01E9030000")), F.substring(wkb_point("lon", "lat"), 6, 16), z)
    return derived(spark, sf, "places").select(F.col("item_id").alias("row_number"), F.lit(None).cast("string").alias("feature_id"), raw.alias("geometry"))


@query(f"{PLACES} SELECT item_id AS row_number FROM places WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30 AND item_id % 1000 BETWEEN 200 AND 700")
def geo_search_3d(spark, sf):
    return _artifact(spark, points3(spark, sf), payload="row-ref").feature_refs(Query("box3d", (-60.0, -30.0, 200.0, 60.0, 30.0, 700.0))).select("row_number")


@query(f"{PLACES} SELECT item_id AS row_number, round(lon, 6) AS min_x, round(lat, 6) AS min_y, (item_id % 1000)::DOUBLE AS min_z FROM places")
def geo_scan_3d(spark, sf):
    return scan_envelopes(points3(spark, sf), dims="3d").select("row_number", F.round("min_x", 6).alias("min_x"), F.round("min_y", 6).alias("min_y"), "min_z")


@query(f"{PLACES} SELECT item_id AS row_number, round(lon, 6) AS min_x, round(lat, 6) AS max_y FROM places WHERE item_id % 3 <> 0")
def geo_scan_nulls(spark, sf):
    """Features without a geometry are left out; a height is, when two dimensions are asked for."""
    some = points3(spark, sf).withColumn("geometry", F.when(F.col("row_number") % 3 != 0, F.col("geometry")))
    return scan_envelopes(some, "skip", dims="2d").select("row_number", F.round("min_x", 6).alias("min_x"), F.round("max_y", 6).alias("max_y"))


@query(f"{SPLIT} SELECT row_number, coalesce(part, -1)::INTEGER AS part, name FROM entry JOIN places ON item_id = row_number WHERE min_x <= 180 AND max_x >= -180 AND min_y <= 30 AND max_y >= -30")
def geo_read_back_all(spark, sf):
    """Every reference of a row, in the source's order."""
    refs = _artifact(spark, lines(spark, sf), payload="row-ref", policy="split").feature_refs(Query("box", (-180.0, -30.0, 180.0, 30.0)))
    source = derived(spark, sf, "places").select(F.col("item_id").alias("row_number"), "name")
    return read_back(refs.withColumn("position", F.col("entry_id")), source, "source", "keep").select("row_number", _part(), "name")


@query(f"{PLACES} SELECT name AS feature_id, round(lon, 6) AS lon, round(lat, 6) AS lat, segment FROM places")
def geojson_lines(spark, sf):
    """Written as a feature a line and read again."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("name").alias("id"), shape.alias("geometry"), F.struct("segment").alias("properties"))
    path = workspace(spark, "geojson")
    derived(spark, sf, "places").select(F.to_json(feature).alias("value")).write.text(path)
    b = read_geojson_lines(spark, path).select("feature_id", "properties", wkb_bounds("geometry").alias("b"))
    segment = F.get_json_object("properties", "$.segment").alias("segment")
    return b.select("feature_id", F.round("b.min_x", 6).alias("lon"), F.round("b.min_y", 6).alias("lat"), segment)


def _covered(spark, sf) -> str:
    """A GeoParquet folder with covering columns; the path of it."""
    path = workspace(spark, "geoparquet")
    box = F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))
    derived(spark, sf, "places").select("name", "segment", wkb_point("lon", "lat").alias("geometry"), box.alias("bbox")).write.parquet(path)
    return path


COVERING = {k: ("bbox", k) for k in ("xmin", "ymin", "xmax", "ymax")}


@query(f"{PLACES} SELECT name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM places WHERE lon BETWEEN 100 AND 179 AND lat BETWEEN -30 AND 30")
def geoparquet_search(spark, sf):
    features = read_parquet_features(spark, _covered(spark, sf), properties=["name"])
    found = _artifact(spark, features, payload="feature-json").matches(BOX)
    return found.select(F.get_json_object("properties", "$.name").alias("name"), F.round("min_x", 6).alias("lon"), F.round("min_y", 6).alias("lat"))


@query(f"{PLACES} SELECT round(lon, 6) AS lon, round(lat, 6) AS lat FROM places WHERE lon BETWEEN 100 AND 179 AND lat BETWEEN -30 AND 30")
def geoparquet_covering_search(spark, sf):
    """Bounds from covering columns: the scan reads no geometry."""
    features = read_parquet_features(spark, _covered(spark, sf), covering=COVERING)
    found = _artifact(spark, features, payload="row-ref").matches(BOX)
    return found.select(F.round("min_x", 6).alias("lon"), F.round("min_y", 6).alias("lat"))
