"""Registered queries on boxes, with SQL written from the definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import curves, geodesy
from tessera.functions.boxes import box_names
from tessera.functions.rays import Ray
from tessera.functions.regions import AnyRegion, BoxRegion, ConvexPolygon, Frustum, Triangle
from tessera.operators import joins
from tessera.operators.frame import SpatialFrame

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


def frame(spark, sf, name="boxes") -> SpatialFrame:
    return SpatialFrame(derived(spark, sf, name), 3 if name.endswith("3") else 2)


def rounded(df: DataFrame, column: str, places: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, places))


OVERLAP2 = "a.min_x <= b.max_x AND a.max_x >= b.min_x AND a.min_y <= b.max_y AND a.max_y >= b.min_y"
OVERLAP3 = OVERLAP2 + " AND a.min_z <= b.max_z AND a.max_z >= b.min_z"
WINDOW = "min_x <= 300 AND max_x >= 200 AND min_y <= 300 AND max_y >= 200"
BOXES, BOXES3 = derived_sql("boxes"), derived_sql("boxes3")


# -- box searches --------------------------------------------------------------


@query(f"{BOXES} SELECT * FROM boxes WHERE {WINDOW}")
def box_search(spark, sf):
    return frame(spark, sf).search(200, 200, 300, 300)


@query(f"{BOXES3} SELECT item_id FROM boxes3 WHERE {WINDOW} AND min_z <= 700 AND max_z >= 100")
def box_search_3d(spark, sf):
    return frame(spark, sf, "boxes3").search(200, 200, 100, 300, 300, 700).select("item_id")


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {WINDOW}")
def box_search_clustered(spark, sf):
    return SpatialFrame.build(derived(spark, sf, "boxes")).search(200, 200, 300, 300).select("item_id")


@query(f"{BOXES} SELECT item_id FROM boxes WHERE min_x <= 250 AND max_x >= 300 AND min_y <= 999 AND max_y >= 0")
def box_search_inverted(spark, sf):
    return frame(spark, sf).search(300, 0, 250, 999).select("item_id")


@query(f"{BOXES} SELECT item_id FROM boxes WHERE min_x <= 222 AND max_x >= 222 AND min_y <= 546 AND max_y >= 546")
def point_stab(spark, sf):
    return frame(spark, sf).stab(222, 546).select("item_id")


@query(f"{BOXES} SELECT count(*)::BIGINT AS matches, min(item_id) AS first_id, count(*) > 0 AS any_match FROM boxes WHERE {WINDOW}")
def count_first_any(spark, sf):
    found = frame(spark, sf).search(200, 200, 300, 300)
    return found.agg(F.count(F.lit(1)).alias("matches"), F.min("item_id").alias("first_id"), (F.count(F.lit(1)) > 0).alias("any_match"))


@query(f"{BOXES} SELECT min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, count(*)::BIGINT AS items FROM boxes")
def extent_and_count(spark, sf):
    df = derived(spark, sf, "boxes")
    return df.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.count(F.lit(1)).alias("items"))


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {WINDOW}")
def single_search_exact(spark, sf):
    exact = frame(spark, sf)
    return exact.to_single().search_exact(exact, 200, 200, 300, 300).select("item_id")


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {WINDOW}")
def single_search(spark, sf):
    """Whole numbers are exact in single precision, so nothing extra comes."""
    return frame(spark, sf).to_single().search_single(200, 200, 300, 300).select("item_id")


@query(f"{derived_sql('boxes', 'regions')} SELECT b.item_id AS window_id, a.item_id FROM boxes a, regions b WHERE {OVERLAP2}")
def window_batch(spark, sf):
    found = joins.overlap_join(derived(spark, sf, "regions"), derived(spark, sf, "boxes"))
    return found.select(F.col("left_id").alias("window_id"), F.col("right_id").alias("item_id"))


@query(f"{BOXES} SELECT item_id, substr(p_name, 1, 6) AS prefix, strlen(p_name)::BIGINT AS payload_len FROM boxes JOIN part ON p_partkey = item_id WHERE {WINDOW}")
def payload_prefixes(spark, sf):
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("item_id"), "p_name")
    return SpatialFrame(derived(spark, sf, "boxes").join(names, "item_id")).prefixes("p_name", 6, 200, 200, 300, 300)


@query(f"{BOXES} SELECT item_id, p_name AS payload FROM boxes JOIN part ON p_partkey = item_id WHERE {WINDOW}")
def payload_search(spark, sf):
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("payload"))
    return frame(spark, sf).search(200, 200, 300, 300).join(names, "item_id").select("item_id", "payload")


@query(f"{BOXES} SELECT item_id, min_x, max_y FROM boxes WHERE item_id IN (3, 17, 99)")
def payload_lookup(spark, sf):
    return frame(spark, sf).lookup(3, 17, 99).select("item_id", "min_x", "max_y")


# -- regions -------------------------------------------------------------------

TRIANGLE = [(100.0, 100.0), (600.0, 200.0), (300.0, 700.0)]
POLYGON = [(500.0, 100.0), (800.0, 250.0), (850.0, 600.0), (600.0, 700.0), (400.0, 400.0)]


def _sat_sql(corners, inside: bool = False) -> str:
    """All four corners of the box against each edge: (x - px) * ey - (y - py) * ex
    is at most 0 inside a polygon that turns left."""
    edges = list(zip(corners, corners[1:] + corners[:1]))
    sides = []
    for (px, py), (qx, qy) in edges:
        ex, ey = qx - px, qy - py
        at = [f"(({x}) - {px}) * {ey} - (({y}) - {py}) * {ex}" for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
        sides.append(f"{'greatest' if inside else 'least'}({', '.join(at)}) <= 0")
    xs, ys = zip(*corners)
    if not inside:
        sides.append(f"min_x <= {max(xs)} AND max_x >= {min(xs)} AND min_y <= {max(ys)} AND max_y >= {min(ys)}")
    return " AND ".join(sides)


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {_sat_sql(TRIANGLE)}")
def region_triangle(spark, sf):
    return frame(spark, sf).search_region(Triangle(*TRIANGLE)).select("item_id")


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {_sat_sql(TRIANGLE, True)}")
def region_triangle_contains(spark, sf):
    return frame(spark, sf).inside_region(Triangle(*TRIANGLE)).select("item_id")


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {_sat_sql(POLYGON)}")
def region_convex_polygon(spark, sf):
    return frame(spark, sf).search_region(ConvexPolygon(POLYGON)).select("item_id")


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {_sat_sql(POLYGON, True)}")
def region_polygon_contains(spark, sf):
    return frame(spark, sf).inside_region(ConvexPolygon(POLYGON)).select("item_id")


PLANES = [(1, 0, 0.5, -300), (-1, 0, 0.25, 600), (0, 1, 0.5, -200), (0, -1, 0.25, 700), (0, 0, 1, -50), (0, 0, -1, 900)]


def _frustum_sql(planes, outer: bool = True) -> str:
    tests = []
    for *n, d in planes:
        terms = [f"{c} * {('max' if (c >= 0) == outer else 'min')}_{a}" for c, a in zip(n, "xyz")]
        tests.append(f"{' + '.join(terms)} + ({d}) >= 0")
    return " AND ".join(tests)


@query(f"{BOXES3} SELECT item_id FROM boxes3 WHERE {_frustum_sql(PLANES)}")
def region_frustum(spark, sf):
    return frame(spark, sf, "boxes3").search_region(Frustum(PLANES)).select("item_id")


@query(f"{BOXES3} SELECT item_id FROM boxes3 WHERE {_frustum_sql(PLANES, False)}")
def region_frustum_contains(spark, sf):
    return frame(spark, sf, "boxes3").inside_region(Frustum(PLANES)).select("item_id")


@query(f"{BOXES3} SELECT item_id FROM boxes3 WHERE max_x >= 100 AND min_x <= 900 AND max_y >= 100 AND min_y <= 900 AND max_z >= 0 AND min_z <= 500")
def region_view_projection(spark, sf):
    matrix = [[1 / 400, 0, 0, -500 / 400], [0, 1 / 400, 0, -500 / 400], [0, 0, 1 / 500, 0], [0, 0, 0, 1]]
    return frame(spark, sf, "boxes3").search_region(Frustum.from_view_projection(matrix)).select("item_id")


@query(f"{BOXES} SELECT item_id FROM boxes WHERE ({WINDOW}) OR ({_sat_sql(TRIANGLE)})")
def region_union(spark, sf):
    return frame(spark, sf).search_region(AnyRegion([BoxRegion(200, 200, 300, 300), Triangle(*TRIANGLE)])).select("item_id")


# -- nearest neighbours --------------------------------------------------------


def _d2_sql(*point: float) -> str:
    return " + ".join(f"pow(greatest(min_{a} - {p}, {p} - max_{a}, 0), 2)" for a, p in zip("xyz", point))


@query(f"{BOXES} SELECT item_id, round({_d2_sql(512.5, 333.25)}, 6) AS distance_squared FROM boxes ORDER BY {_d2_sql(512.5, 333.25)}, item_id LIMIT 10")
def knn_point(spark, sf):
    return rounded(frame(spark, sf).neighbors((512.5, 333.25), 10).select("item_id", "distance_squared"), "distance_squared")


@query(f"{BOXES3} SELECT item_id, round({_d2_sql(512.5, 333.25, 400)}, 6) AS distance_squared FROM boxes3 ORDER BY {_d2_sql(512.5, 333.25, 400)}, item_id LIMIT 10")
def knn_point_3d(spark, sf):
    return rounded(frame(spark, sf, "boxes3").neighbors((512.5, 333.25, 400), 10).select("item_id", "distance_squared"), "distance_squared")


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {_d2_sql(512.5, 333.25)} <= 625 ORDER BY {_d2_sql(512.5, 333.25)}, item_id LIMIT 100")
def knn_within(spark, sf):
    return frame(spark, sf).neighbors((512.5, 333.25), 100, 25.0).select("item_id")


@query(f"{BOXES} SELECT item_id FROM boxes ORDER BY {_d2_sql(100, 100)}, item_id LIMIT 1")
def knn_one(spark, sf):
    return frame(spark, sf).neighbors((100, 100), 1).select("item_id")


_GAP = "pow(greatest(400 - max_x, min_x - 420, 0), 2) + pow(greatest(500 - max_y, min_y - 530, 0), 2)"


@query(f"{BOXES} SELECT item_id, {_GAP} AS distance_squared FROM boxes ORDER BY {_GAP}, item_id LIMIT 12")
def knn_box(spark, sf):
    return frame(spark, sf).neighbors_of_box((400, 500, 420, 530), 12).select("item_id", "distance_squared")


_MANHATTAN = "greatest(min_x - 640, 640 - max_x, 0) + greatest(min_y - 250, 250 - max_y, 0)"


@query(f"{BOXES} SELECT item_id, {_MANHATTAN} AS distance FROM boxes WHERE {_MANHATTAN} <= 90 ORDER BY {_MANHATTAN}, item_id LIMIT 15")
def knn_metric(spark, sf):
    def manhattan(b):
        gaps = [F.greatest(lo - p, p - hi, F.lit(0.0)) for lo, hi, p in zip(b.low, b.high, (640.0, 250.0))]
        return gaps[0] + gaps[1]

    return frame(spark, sf).neighbors_metric(manhattan, 15, 90).select("item_id", "distance")


def _haversine_sql(lon1, lat1, lon2, lat2) -> str:
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * 6371008.8 * asin(least(1.0, sqrt({h})))"


_PLACES = derived_sql("places")


def _place_frame(spark, sf):
    return SpatialFrame.from_points(derived(spark, sf, "places"), ["lon", "lat"], curve=None)


@query(f"{_PLACES} SELECT item_id, round({_haversine_sql(13.4, 52.5, 'lon', 'lat')}, 3) AS distance FROM places ORDER BY {_haversine_sql(13.4, 52.5, 'lon', 'lat')}, item_id LIMIT 8")
def knn_haversine(spark, sf):
    found = _place_frame(spark, sf).neighbors_metric(lambda b: geodesy.haversine_to_box(13.4, 52.5, b), 8)
    return rounded(found.select("item_id", "distance"), "distance", 3)


@query(
    f"""{derived_sql('boxes', 'sites')}, d AS (
  SELECT query_id, item_id, pow(greatest(min_x - x, x - max_x, 0), 2) + pow(greatest(min_y - y, y - max_y, 0), 2) AS distance_squared FROM sites, boxes
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance_squared, item_id)::INTEGER AS rank FROM d)
SELECT * FROM r WHERE rank <= 4"""
)
def knn_join(spark, sf):
    return joins.knn_join(derived(spark, sf, "sites"), derived(spark, sf, "boxes"), 4)


# -- joins ---------------------------------------------------------------------


@query(f"{derived_sql('boxes', 'regions')} SELECT a.item_id AS left_id, b.item_id AS right_id FROM boxes a, regions b WHERE {OVERLAP2}")
def spatial_join(spark, sf):
    return joins.overlap_join(derived(spark, sf, "boxes"), derived(spark, sf, "regions"))


@query(f"{derived_sql('boxes3', 'regions3')} SELECT a.item_id AS left_id, b.item_id AS right_id FROM boxes3 a, regions3 b WHERE {OVERLAP3}")
def spatial_join_3d(spark, sf):
    return joins.overlap_join(derived(spark, sf, "boxes3"), derived(spark, sf, "regions3"), 3)


@query(f"{derived_sql('boxes', 'regions')} SELECT a.item_id AS left_id, b.item_id AS right_id FROM boxes a, regions b WHERE {OVERLAP2}")
def spatial_join_broadcast(spark, sf):
    return joins.broadcast_join(derived(spark, sf, "boxes"), derived(spark, sf, "regions"))


@query(f"{derived_sql('boxes')} SELECT a.item_id AS left_id, b.item_id AS right_id FROM boxes a, boxes b WHERE a.item_id < b.item_id AND {OVERLAP2}")
def spatial_self_join(spark, sf):
    return joins.self_join(derived(spark, sf, "boxes"))


@query(f"{derived_sql('boxes', 'regions')} SELECT a.item_id FROM boxes a WHERE EXISTS (SELECT 1 FROM regions b WHERE {OVERLAP2})")
def spatial_semi_join(spark, sf):
    return joins.semi_join(derived(spark, sf, "boxes"), derived(spark, sf, "regions")).select("item_id")


# -- rays ----------------------------------------------------------------------


def _slab_sql(origin, direction, dims: int, most, table: str = "") -> str:
    """A CTE body's columns: near, far over the slabs, and the zero-direction tests."""
    near, far, still = ["0.0"], [str(most)], []
    for a, o, d in list(zip("xyz", origin, direction))[:dims]:
        lo, hi = f"{table}min_{a}", f"{table}max_{a}"
        near.append(f"CASE WHEN {d} = 0 THEN 0.0 ELSE least(({lo} - {o}) / nullif({d}, 0), ({hi} - {o}) / nullif({d}, 0)) END")
        far.append(f"CASE WHEN {d} = 0 THEN {most} ELSE greatest(({lo} - {o}) / nullif({d}, 0), ({hi} - {o}) / nullif({d}, 0)) END")
        still.append(f"({d} <> 0 OR ({lo} <= {o} AND {o} <= {hi}))")
    return f"greatest({', '.join(near)}) AS t, least({', '.join(far)}) AS far, ({' AND '.join(still)}) AS still"


_RAY2 = _slab_sql((10, 20), (3, 2), 2, 300)
_RAY3 = _slab_sql((0, 0, 500), (1, 1, 0), 3, 1000)


@query(f"{BOXES}, h AS (SELECT item_id, {_RAY2} FROM boxes) SELECT item_id, round(t, 6) AS t FROM h WHERE still AND t <= far")
def raycast_all(spark, sf):
    return rounded(frame(spark, sf).raycast(Ray((10, 20), (3, 2), 300)).select("item_id", "t"), "t")


@query(f"{BOXES}, h AS (SELECT item_id, {_RAY2} FROM boxes) SELECT item_id, round(t, 6) AS t FROM h WHERE still AND t <= far ORDER BY h.t, item_id LIMIT 1")
def raycast_closest(spark, sf):
    return rounded(frame(spark, sf).raycast_closest(Ray((10, 20), (3, 2), 300)), "t")


@query(f"{BOXES3}, h AS (SELECT item_id, {_RAY3} FROM boxes3) SELECT item_id, round(t, 6) AS t FROM h WHERE still AND t <= far")
def raycast_3d(spark, sf):
    return rounded(frame(spark, sf, "boxes3").raycast_ordered(Ray((0, 0, 500), (1, 1, 0), 1000)).select("item_id", "t"), "t")


_MANY = _slab_sql([f"r.o{a}" for a in "xyz"], [f"r.d{a}" for a in "xyz"], 3, "r.max_t", "b.")


@query(f"{derived_sql('rays', 'regions3')}, h AS (SELECT ray_id, item_id, {_MANY} FROM rays r, regions3 b) SELECT ray_id, item_id, round(t, 6) AS t FROM h WHERE still AND t <= far")
def ray_batch(spark, sf):
    return rounded(joins.ray_join(derived(spark, sf, "rays"), derived(spark, sf, "regions3")), "t")


@query(
    f"""{derived_sql('rays', 'regions3')}, h AS (SELECT ray_id, item_id, {_MANY} FROM rays r, regions3 b),
k AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, item_id) AS place FROM h WHERE still AND t <= far)
SELECT ray_id, item_id, round(t, 6) AS t FROM k WHERE place = 1"""
)
def ray_batch_closest(spark, sf):
    return rounded(joins.closest_on_rays(derived(spark, sf, "rays"), derived(spark, sf, "regions3")), "t")


@query(
    f"""{derived_sql('triangles')}, e AS (
  SELECT item_id, bx - ax AS ux, "by" - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz, 50.0 - ax AS sx, 50.5 - ay AS sy, -10.0 - az AS sz FROM triangles
), d AS (
  SELECT *, 0.1 * 0 AS z, (0.01 * vz - 1.0 * vy) AS hx, (1.0 * vx - 0.02 * vz) AS hy, (0.02 * vy - 0.01 * vx) AS hz FROM e
), m AS (
  SELECT *, ux * hx + uy * hy + uz * hz AS det, sy * uz - sz * uy AS qx, sz * ux - sx * uz AS qy, sx * uy - sy * ux AS qz FROM d
), w AS (
  SELECT item_id, det, (sx * hx + sy * hy + sz * hz) / nullif(det, 0) AS u, (0.02 * qx + 0.01 * qy + 1.0 * qz) / nullif(det, 0) AS v, (vx * qx + vy * qy + vz * qz) / nullif(det, 0) AS t FROM m
)
SELECT item_id, round(t, 6) AS t FROM w WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t BETWEEN 0 AND 500 ORDER BY w.t, item_id LIMIT 1"""
)
def closest_triangle(spark, sf):
    mesh = SpatialFrame.from_triangles(derived(spark, sf, "triangles"), curve=None)
    return rounded(mesh.closest_triangle(Ray((50.0, 50.5, -10.0), (0.02, 0.01, 1.0), 500)), "t")


@query(
    f"""{derived_sql('triangles')} SELECT item_id, least(ax, bx, cx) AS min_x, least(ay, "by", cy) AS min_y, least(az, bz, cz) AS min_z,
  greatest(ax, bx, cx) AS max_x, greatest(ay, "by", cy) AS max_y, greatest(az, bz, cz) AS max_z FROM triangles"""
)
def triangle_bounds(spark, sf):
    return SpatialFrame.from_triangles(derived(spark, sf, "triangles"), curve=None).df.select("item_id", *box_names(3))


# -- functions -----------------------------------------------------------------


@query(f"{_PLACES} SELECT item_id, round({_haversine_sql('lon', 'lat', 2.3522, 48.8566)}, 3) AS metres FROM places")
def haversine_distance(spark, sf):
    df = derived(spark, sf, "places")
    return df.select("item_id", F.round(geodesy.haversine(F.col("lon"), F.col("lat"), 2.3522, 48.8566), 3).alias("metres"))


@query(f"{_PLACES} SELECT item_id, round(CASE WHEN lon * 3 BETWEEN -180 AND 180 THEN lon * 3 ELSE (((lon * 3 + 180) % 360) + 360) % 360 - 180 END, 6) AS lon FROM places")
def normalise_longitude(spark, sf):
    df = derived(spark, sf, "places")
    return df.select("item_id", F.round(geodesy.normalise_longitude(F.col("lon") * 3), 6).alias("lon"))


@query(f"{_PLACES} SELECT item_id FROM places WHERE {_haversine_sql(179.5, -16.5, 'lon', 'lat')} <= 3000000")
def radius_search(spark, sf):
    boxes = AnyRegion([BoxRegion(*b) for b in geodesy.radius_boxes(179.5, -16.5, 3_000_000)])
    found = _place_frame(spark, sf).search_region(boxes)
    return found.filter(geodesy.haversine(F.col("lon"), F.col("lat"), 179.5, -16.5) <= 3_000_000).select("item_id")


_BITS = " | ".join(f"((({{c}} >> {k}) & 1) << {2 * k})" for k in range(16))


@query(
    f"""{BOXES}, c AS (SELECT item_id, ((p * 37) % 1000 * 65)::BIGINT AS x, ((p * 91) % 1000 * 65)::BIGINT AS y FROM (SELECT item_id, item_id AS p FROM boxes))
SELECT item_id, ({_BITS.format(c='x')}) | (({_BITS.format(c='y')}) << 1) AS morton FROM c"""
)
def morton_key(spark, sf):
    df = derived(spark, sf, "boxes").select("item_id", ((F.col("item_id") * 37) % 1000 * 65).alias("x"), ((F.col("item_id") * 91) % 1000 * 65).alias("y"))
    return df.select("item_id", curves.morton([F.col("x"), F.col("y")]).alias("morton"))


def _hilbert_sql() -> str:
    steps = f"""{BOXES}, s0 AS (SELECT item_id, (item_id * 37) % 1000 * 65 AS x, (item_id * 91) % 1000 * 65 AS y, 0::BIGINT AS d FROM boxes)"""
    for k in range(16):
        side = 1 << (15 - k)
        steps += f""", r{k} AS (SELECT item_id, x % {side} AS x, y % {side} AS y, CASE WHEN x >= {side} THEN 1 ELSE 0 END AS rx, CASE WHEN y >= {side} THEN 1 ELSE 0 END AS ry, d FROM s{k})
, s{k + 1} AS (SELECT item_id, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN {side - 1} - y ELSE y END AS x, CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN {side - 1} - x ELSE x END AS y,
  d + {side * side}::BIGINT * CASE WHEN rx = 0 AND ry = 0 THEN 0 WHEN rx = 0 THEN 1 WHEN ry = 1 THEN 2 ELSE 3 END AS d FROM r{k})"""
    return steps + " SELECT item_id, d::BIGINT AS hilbert FROM s16"


@query(_hilbert_sql())
def hilbert_key(spark, sf):
    df = derived(spark, sf, "boxes").select("item_id", ((F.col("item_id") * 37) % 1000 * 65).alias("x"), ((F.col("item_id") * 91) % 1000 * 65).alias("y"))
    return df.select("item_id", curves.hilbert_2d(F.col("x"), F.col("y")).alias("hilbert"))


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {WINDOW}")
def container_search(spark, sf):
    """Packed trees as rows of a table, pruned by their bounds and descended."""
    from tessera.sources.boxtree import pack_containers, search_containers

    from .staging import workspace

    path = workspace(spark, "containers")
    pack_containers(SpatialFrame.build(derived(spark, sf, "boxes")).df).write.parquet(path)
    return search_containers(spark.read.parquet(path), (200, 200, 300, 300))


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {WINDOW}")
def file_search(spark, sf):
    """Written clustered, read back with the window pushed to the scan."""
    from .staging import workspace

    path = workspace(spark, "boxes")
    SpatialFrame.build(derived(spark, sf, "boxes")).write(path)
    return SpatialFrame.read(spark, path).search(200, 200, 300, 300).select("item_id")


_POINTS64 = "SELECT vec_id AS item_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"


@query(f"WITH p AS ({_POINTS64}) SELECT item_id FROM p WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.1 AND 0.1")
def single_precision_points(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = e.select(F.col("vec_id").alias("item_id"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])
    exact = SpatialFrame.from_points(p, ["x", "y", "z"], curve=None)
    return exact.to_single().search_exact(exact, -0.1, -0.1, -0.1, 0.1, 0.1, 0.1).select("item_id")


@query(f"WITH p AS ({_POINTS64}), d AS (SELECT item_id, pow(x - 0.05, 2) + pow(y, 2) + pow(z + 0.05, 2) AS d FROM p) SELECT item_id, round(d, 9) AS distance_squared FROM d ORDER BY d.d, item_id LIMIT 8")
def knn_embedding_points(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = e.select(F.col("vec_id").alias("item_id"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])
    found = SpatialFrame.from_points(p, ["x", "y", "z"], curve=None).neighbors((0.05, 0.0, -0.05), 8)
    return rounded(found.select("item_id", "distance_squared"), "distance_squared", 9)


@query(f"{derived_sql('boxes', 'sites')} SELECT query_id, min(item_id) AS first_box, count(*)::BIGINT AS boxes FROM sites, boxes WHERE x - 20 <= max_x AND x + 20 >= min_x AND y - 20 <= max_y AND y + 20 >= min_y GROUP BY query_id")
def windows_around_points(spark, sf):
    sites = derived(spark, sf, "sites").select(
        F.col("query_id").alias("item_id"), (F.col("x") - 20).alias("min_x"), (F.col("y") - 20).alias("min_y"), (F.col("x") + 20).alias("max_x"), (F.col("y") + 20).alias("max_y")
    )
    found = joins.overlap_join(sites, derived(spark, sf, "boxes"))
    return found.groupBy(F.col("left_id").alias("query_id")).agg(F.min("right_id").alias("first_box"), F.count(F.lit(1)).alias("boxes"))


# -- containers and singles ------------------------------------------------------


def _containers(spark, sf, name, dims):
    from tessera.sources.boxtree import pack_containers

    from .staging import workspace

    path = workspace(spark, "containers")
    pack_containers(SpatialFrame.build(derived(spark, sf, name), dims).df, dims).write.parquet(path)
    return spark.read.parquet(path)


@query(f"{BOXES} SELECT item_id FROM boxes WHERE {_sat_sql(POLYGON)}")
def container_polygon_search(spark, sf):
    from tessera.sources.boxtree import search_containers

    return search_containers(_containers(spark, sf, "boxes", 2), ConvexPolygon(POLYGON))


@query(f"{BOXES3} SELECT item_id FROM boxes3 WHERE {_frustum_sql(PLANES)}")
def container_frustum_search(spark, sf):
    from tessera.sources.boxtree import search_containers

    return search_containers(_containers(spark, sf, "boxes3", 3), Frustum(PLANES))


@query(ORACLES["knn_embedding_points"])
def single_knn_exact(spark, sf):
    """Rounded boxes narrow the search, exact ones rank."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = e.select(F.col("vec_id").alias("item_id"), *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])
    exact = SpatialFrame.from_points(p, ["x", "y", "z"], curve=None)
    found = exact.to_single().neighbors_exact(exact, (0.05, 0.0, -0.05), 8)
    return rounded(found.select("item_id", "distance_squared"), "distance_squared", 9)


@query(f"{BOXES} SELECT min(item_id) AS first_id, count(*) > 0 AS any_match FROM boxes WHERE {WINDOW}")
def single_first_exact(spark, sf):
    exact = frame(spark, sf)
    single = exact.to_single()
    found = (single.first_exact(exact, 200, 200, 300, 300), single.any_exact(exact, 200, 200, 300, 300))
    return spark.createDataFrame([found], "first_id long, any_match boolean")


@query(f"{BOXES} SELECT item_id, min_x <= max_x - 5 AND min_y <= max_y AS valid FROM boxes")
def box_validity(spark, sf):
    from tessera.functions.boxes import box_columns, is_valid

    df = derived(spark, sf, "boxes").withColumn("max_x", F.col("max_x") - 5)
    return df.select("item_id", is_valid(box_columns(2)).alias("valid"))


_BITS3 = " | ".join(f"((({{c}} >> {k}) & 1) << {3 * k})" for k in range(16))


@query(
    f"""{BOXES}, c AS (SELECT item_id, ((item_id * 37) % 1000 * 65)::BIGINT AS x, ((item_id * 91) % 1000 * 65)::BIGINT AS y, ((item_id * 53) % 1000 * 65)::BIGINT AS z FROM boxes)
SELECT item_id, ({_BITS3.format(c='x')}) | (({_BITS3.format(c='y')}) << 1) | (({_BITS3.format(c='z')}) << 2) AS morton FROM c"""
)
def morton_key_3d(spark, sf):
    cells = [((F.col("item_id") * m) % 1000 * 65) for m in (37, 91, 53)]
    return derived(spark, sf, "boxes").select("item_id", curves.morton(cells).alias("morton"))


@query(f"{BOXES} SELECT item_id, item_id * 3 AS row_number, CASE WHEN item_id % 2 = 0 THEN item_id % 7 END::INTEGER AS part, 2::BIGINT AS body FROM boxes")
def reference_codec(spark, sf):
    """Written as bytes and read again, with a body behind."""
    from tessera.sources.records import decode_reference, encode_reference, reference_body

    part = F.when(F.col("item_id") % 2 == 0, (F.col("item_id") % 7).cast("int"))
    none = F.lit(None).cast("long")
    rows = derived(spark, sf, "boxes").select("item_id", encode_reference(F.col("item_id") * 3, none, none, part, F.lit("ab").cast("binary")).alias("p"))
    found = rows.select("item_id", decode_reference("p").alias("r"), F.octet_length(reference_body("p")).cast("long").alias("body"))
    return found.select("item_id", "r.row_number", "r.part", "body")
