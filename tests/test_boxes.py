"""Searches, joins, rays and curves against brute force over whole-number grids,
where edges collide."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import curves, geodesy, single
from tessera.functions.boxes import box, box_columns, box_names, checked_box, contains, contains_point, distance_squared, gap_squared, overlaps
from tessera.functions.rays import Ray, enter_t, triangle_columns, with_triangle_t
from tessera.functions.regions import BoxRegion, ConvexPolygon, Frustum, Triangle
from tessera.operators import joins
from tessera.operators.frame import InvalidBounds, ItemCountMismatch, SpatialFrame


def grid_boxes(n, dims=2, seed=1, size=5, side=15):
    rng = np.random.default_rng(seed)
    low = rng.integers(0, side, (n, dims))
    return np.hstack([low, low + rng.integers(0, size, (n, dims))]).astype(float)


def table(spark, boxes, dims=2, first=0):
    rows = [(first + i, *map(float, b)) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, f"item_id long, {', '.join(f'{n} double' for n in box_names(dims))}")


def meets(a, b):
    d = len(a) // 2
    return all(a[k] <= b[k + d] and a[k + d] >= b[k] for k in range(d))


@pytest.fixture(scope="module")
def boxes():
    return grid_boxes(60)


@pytest.fixture(scope="module")
def frame(spark, boxes):
    return SpatialFrame.build(table(spark, boxes))


def ids(df, name="item_id"):
    return sorted(r[name] for r in df.select(name).collect())


def test_search(frame, boxes):
    for q in grid_boxes(6, seed=2, size=8):
        assert ids(frame.search(*q)) == [i for i, b in enumerate(boxes) if meets(b, q)]
    q = (3.0, 3.0, 9.0, 9.0)
    want = [i for i, b in enumerate(boxes) if meets(b, q)]
    assert frame.count_matches(*q) == len(want) and frame.first(*q) == want[0] and frame.any(*q)
    assert not frame.any(100, 100, 101, 101) and frame.first(100, 100, 101, 101) is None
    assert ids(frame.stab(7, 7)) == [i for i, b in enumerate(boxes) if meets(b, (7, 7, 7, 7))]
    seen = []
    assert frame.visit(lambda r: seen.append(r) or len(seen) == 2, *q) and len(seen) == 2
    assert frame.extent() == (*boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0)) and frame.count() == 60
    assert ids(frame.lookup(3, 5, 999)) == [3, 5]


def test_odd_windows(frame, boxes):
    nan = math.nan
    assert ids(frame.search(nan, 0, 10, 10)) == ids(frame.search(0, 0, 10, nan)) == []
    assert ids(frame.search(9, 0, 4, 20)) == [i for i, b in enumerate(boxes) if b[0] <= 4 and b[2] >= 9 and b[1] <= 20]
    assert len(ids(frame.search(-math.inf, -math.inf, math.inf, math.inf))) == 60
    with pytest.raises(ValueError):
        checked_box(1, 0, 0, 1)
    with pytest.raises(ValueError):
        checked_box(nan, 0, 0, 1)


def test_build_refuses(spark):
    for bad in ([1, 0, 0, 1], [0, 1, 1, 0], [math.nan, 0, 1, 1], [0, 0, 1, math.nan]):
        with pytest.raises(InvalidBounds):
            SpatialFrame.build(table(spark, [[0, 0, 1, 1], bad]))
    with pytest.raises(ItemCountMismatch):
        SpatialFrame.build(table(spark, [[0, 0, 1, 1]]), expected_items=2)
    assert SpatialFrame.build(table(spark, [[-math.inf, 0, math.inf, 1]])).count() == 1
    empty = SpatialFrame.build(table(spark, [[0, 0, 1, 1]]).limit(0))
    assert empty.extent() is None and ids(empty.search(0, 0, 1, 1)) == []


def test_pushdown_and_files(spark, frame, tmp_path):
    frame.write(f"file://{tmp_path}/boxes")
    stored = SpatialFrame.read(spark, f"file://{tmp_path}/boxes")
    assert ids(stored.search(3, 3, 9, 9)) == ids(frame.search(3, 3, 9, 9))
    plan = stored.search(3, 3, 9, 9)._jdf.queryExecution().executedPlan().toString()
    for part in ("LessThanOrEqual(min_x,9.0)", "GreaterThanOrEqual(max_x,3.0)", "LessThanOrEqual(min_y,9.0)", "GreaterThanOrEqual(max_y,3.0)"):
        assert part in plan


def test_pair_functions(spark):
    a, b = grid_boxes(40, 3, 3), grid_boxes(40, 3, 4)
    rows = [(*map(float, x), *map(float, y)) for x, y in zip(a, b)]
    names = [*box_names(3, "a_"), *box_names(3, "b_")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    one, two = box_columns(3, "a_"), box_columns(3, "b_")
    got = df.select(overlaps(one, two).alias("o"), contains(one, two).alias("c"), contains_point(one, two.low).alias("p"), distance_squared(one, two.low).alias("d"), gap_squared(one, two).alias("g")).collect()
    for r, x, y in zip(got, a, b):
        assert r.o == meets(x, y)
        assert r.c == all(x[k] <= y[k] and x[k + 3] >= y[k + 3] for k in range(3))
        gap = lambda p, q: sum(max(x[k] - q[k], p[k] - x[k + 3], 0) ** 2 for k in range(3))
        assert r.d == gap(y[:3], y[:3]) and r.g == gap(y[:3], y[3:]) and r.p == (r.d == 0)


def test_neighbors(frame, boxes):
    def d2(b, p):
        return sum(max(b[k] - p[k], p[k] - b[k + 2], 0) ** 2 for k in range(2))

    for p in ((7.0, 7.0), (-3.0, 20.0)):
        want = sorted((d2(b, p), i) for i, b in enumerate(boxes))
        got = [(r.distance_squared, r.item_id) for r in frame.neighbors(p, 9).collect()]
        assert got == want[:9]
        near = [(r.distance_squared, r.item_id) for r in frame.neighbors(p, None, 4.0).collect()]
        assert near == [w for w in want if w[0] <= 16]
    assert frame.neighbors((math.nan, 0), 3).count() == frame.neighbors((0, 0), 3, -1.0).count() == frame.neighbors((0, 0), 3, math.nan).count() == 0
    assert frame.neighbors((7, 7), 60, -0.0).count() == frame.stab(7, 7).count()
    assert frame.neighbors_of_box((0, 0, math.nan, math.nan), None).filter("distance_squared = 0").count() == 60
    by_x = frame.neighbors_metric(lambda b: F.abs(b.low[0] - 7), 5)
    assert [r.item_id for r in by_x.collect()] == [i for _, i in sorted((abs(b[0] - 7), i) for i, b in enumerate(boxes))[:5]]


def test_regions(spark, frame, boxes):
    rng = np.random.default_rng(6)
    corners = lambda b: [(b[i], b[j]) for i in (0, 2) for j in (1, 3)]

    def separated(poly, b):
        axes = [(1, 0), (0, 1)] + [(q[1] - p[1], p[0] - q[0]) for p, q in zip(poly, poly[1:] + poly[:1])]
        for ax in axes:
            one, two = [ax[0] * x + ax[1] * y for x, y in poly], [ax[0] * x + ax[1] * y for x, y in corners(b)]
            if max(one) < min(two) or max(two) < min(one):
                return True
        return False

    for k in range(5):
        t = [tuple(map(float, p)) for p in rng.integers(0, 16, (3, 2))]
        assert ids(frame.search_region(Triangle(*t))) == [i for i, b in enumerate(boxes) if not separated(t, b)], t
        n = 3 + k % 4
        poly = [(7 + 5 * math.cos(2 * math.pi * i / n), 8 + 5 * math.sin(2 * math.pi * i / n)) for i in range(n)]
        assert ids(frame.search_region(ConvexPolygon(poly))) == [i for i, b in enumerate(boxes) if not separated(poly, b)]
        inside = [i for i, b in enumerate(boxes) if all((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0 for p, q in zip(poly, poly[1:] + poly[:1]) for x, y in corners(b))]
        assert ids(frame.inside_region(ConvexPolygon(poly))) == inside
    assert ids(frame.search_region(ConvexPolygon([(0, 0), (9, 9)]))) == []
    assert ids(frame.inside_region(Triangle((0, 0), (5, 5), (9, 9)))) == []
    assert ids(frame.search_region(BoxRegion(3, 3, 9, 9))) == ids(frame.search(3, 3, 9, 9))


def test_frustum(spark):
    boxes = grid_boxes(60, 3, 7)
    solid = SpatialFrame.build(table(spark, boxes, 3), 3)
    cube = Frustum([(1, 0, 0, -2), (-1, 0, 0, 9), (0, 1, 0, -2), (0, -1, 0, 9), (0, 0, 1, -2), (0, 0, -1, 9)])
    assert ids(solid.search_region(cube)) == [i for i, b in enumerate(boxes) if meets(b, (2, 2, 2, 9, 9, 9))]
    assert cube.corners_box() == pytest.approx((2, 2, 2, 9, 9, 9))
    assert Frustum([(1, 0, 0, 0)] * 6).corners_box() is None
    identity = Frustum.from_view_projection(np.eye(4))
    assert identity.corners_box() == pytest.approx((-1, -1, 0, 1, 1, 1))
    assert Frustum.from_view_projection(np.eye(4), depth_from_zero=False).corners_box() == pytest.approx((-1, -1, -1, 1, 1, 1))


def brute_enter(o, d, most, b):
    n = len(o)
    near, far = 0.0, most
    if not all(map(math.isfinite, [*o, *d])) or not most >= 0:
        return None
    for k in range(n):
        if d[k] == 0:
            if not b[k] <= o[k] <= b[k + n]:
                return None
        else:
            t = sorted(((b[k] - o[k]) / d[k], (b[k + n] - o[k]) / d[k]))
            near, far = max(near, t[0]), min(far, t[1])
    return near if near <= far else None


def test_rays(spark):
    rng = np.random.default_rng(8)
    for dims in (2, 3):
        boxes = grid_boxes(50, dims, 9)
        solid = SpatialFrame.build(table(spark, boxes, dims), dims)
        for k in range(6):
            o, d = rng.integers(0, 15, dims).tolist(), rng.integers(-2, 3, dims).tolist()
            most = math.inf if k == 0 else float(k)
            want = {i: t for i, b in enumerate(boxes) if (t := brute_enter(o, d, most, b)) is not None}
            ray = Ray(tuple(o), tuple(d), most)
            assert {r.item_id: r.t for r in solid.raycast(ray).collect()} == pytest.approx(want)
            best = solid.raycast_closest(ray).collect()
            assert [(r.t, r.item_id) for r in best] == ([min((t, i) for i, t in want.items())] if want else [])
    point = SpatialFrame.build(table(spark, [[0, 0, 2, 2], [5, 0, 6, 2]]))
    assert [(r.item_id, r.t) for r in point.raycast(Ray((1, 1), (0, 0), 0)).collect()] == [(0, 0.0)]
    assert [r.item_id for r in point.raycast_ordered(Ray((-1, 2), (1, 0), 6)).collect()] == [0, 1]  # grazing, and an end that just reaches
    for bad in (Ray((math.nan, 0), (1, 0)), Ray((0, 0), (math.inf, 0)), Ray((0, 0), (1, 0), -1.0)):
        assert point.raycast(bad).count() == 0
    df = table(spark, [[0, 0, 2, 2]]).withColumn("t", enter_t(Ray((0.0, 1.0), (5e-324, 1.0)), box_columns(2)))
    assert df.first().t == 0


def test_triangles(spark):
    rng = np.random.default_rng(10)
    mesh = rng.integers(0, 10, (40, 9)).astype(float)
    names = [f"{c}{a}" for c in "abc" for a in "xyz"]
    df = spark.createDataFrame([(i, *map(float, m)) for i, m in enumerate(mesh)], "item_id long, " + ", ".join(f"{n} double" for n in names))
    o, d = np.array([4.3, 4.1, -5.0]), np.array([0.05, 0.02, 1.0])
    got = {r.item_id: r.t for r in with_triangle_t(df, Ray(tuple(o), tuple(d), 40), triangle_columns()).filter("t IS NOT NULL").collect()}
    want = {}
    for i, m in enumerate(mesh.reshape(-1, 3, 3)):
        system = np.stack([m[1] - m[0], m[2] - m[0], -d], axis=1)
        if abs(np.linalg.det(system)) > 1e-9:
            u, v, t = np.linalg.solve(system, o - m[0])
            if u >= 0 and v >= 0 and u + v <= 1 and 0 <= t <= 40:
                want[i] = t
    assert got == pytest.approx(want) and got
    solid = SpatialFrame.from_triangles(df, item_id="item_id")
    assert solid.closest_triangle(Ray(tuple(o), tuple(d), 40)).first().item_id == min((t, i) for i, t in want.items())[1]


def test_joins(spark):
    for dims in (2, 3):
        a, b = grid_boxes(70, dims, 11, 4, 40), grid_boxes(50, dims, 12, 9, 40)
        a[0] = [-math.inf] * dims + [math.inf] * dims
        a[1] = [0] * dims + [1000] * dims
        b[2] = [5] * dims + [math.inf] * dims
        left, right = table(spark, a, dims), table(spark, b, dims, 1000)
        want = sorted((i, 1000 + j) for i, x in enumerate(a) for j, y in enumerate(b) if meets(x, y))
        assert sorted((r.left_id, r.right_id) for r in joins.overlap_join(left, right, dims).collect()) == want
        assert sorted((r.left_id, r.right_id) for r in joins.broadcast_join(left, right, dims).collect()) == want
        assert ids(joins.semi_join(left, right, dims)) == sorted({i for i, _ in want})
        pairs = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(a) if i < j and meets(x, y))
        assert sorted((r.left_id, r.right_id) for r in joins.self_join(left, dims).collect()) == pairs
    assert joins.overlap_join(left.limit(0), right, 3).count() == 0
    plan = joins.overlap_join(left, right, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_knn_join(spark):
    rng = np.random.default_rng(13)
    boxes = grid_boxes(80, 2, 14, 3, 60)
    points = np.vstack([rng.integers(0, 60, (12, 2)), [[500, 500]]]).astype(float)
    queries = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(99, math.nan, 0.0)], "query_id long, x double, y double")
    d2 = lambda b, p: sum(max(b[k] - p[k], p[k] - b[k + 2], 0) ** 2 for k in range(2))
    for k, most in ((3, None), (100, None), (5, 4.0)):
        want = []
        for i, p in enumerate(points):
            best = sorted((d2(b, p), j) for j, b in enumerate(boxes))
            best = [x for x in best if most is None or x[0] <= most * most][:k]
            want += [(i, j, d, r + 1) for r, (d, j) in enumerate(best)]
        got = joins.knn_join(queries, table(spark, boxes), k, max_distance=most)
        assert sorted((r.query_id, r.item_id, r.distance_squared, r["rank"]) for r in got.collect()) == sorted(want)


def test_ray_join(spark):
    rng = np.random.default_rng(15)
    boxes = grid_boxes(60, 3, 16, 4, 12)
    rays = [(i, *map(float, rng.integers(0, 12, 3)), *map(float, rng.integers(-2, 3, 3)), math.inf if i % 3 == 0 else float(i)) for i in range(15)]
    df = spark.createDataFrame(rays, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, max_t double")
    want = {(r[0], i): t for r in rays for i, b in enumerate(boxes) if (t := brute_enter(r[1:4], r[4:7], r[7], b)) is not None}
    assert {(r.ray_id, r.item_id): r.t for r in joins.ray_join(df, table(spark, boxes, 3)).collect()} == pytest.approx(want)
    first = {}
    for (ray, i), t in want.items():
        first[ray] = min(first.get(ray, (math.inf, 0)), (t, i))
    assert {r.ray_id: (r.t, r.item_id) for r in joins.closest_on_rays(df, table(spark, boxes, 3)).collect()} == first


def test_single_precision(spark):
    values = np.array([1 + 1e-8, -1 - 1e-8, 0.1, 1e300, -1e300, 3.0, math.inf])
    with np.errstate(over="ignore"):
        assert (single.down(values).astype(float) <= values).all() and (single.up(values).astype(float) >= values).all()
    assert single.down(np.array([3.0]))[0] == single.up(np.array([3.0]))[0] == 3
    exact = SpatialFrame.build(table(spark, [[1 + 1e-8, 0, 1 + 1e-8, 0], [1, 0, 1, 0]]))
    rounded = exact.to_single()
    assert dict(rounded.df.dtypes)["min_x"] == "float"
    assert set(ids(rounded.search_single(1, 0, 1, 0))) >= {1} and ids(rounded.search_exact(exact, 1, 0, 1, 0)) == [1]


def test_curves(spark):
    cells = [(x, y) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(cells, "x long, y long")
    got = {(r.x, r.y): (r.h, r.m) for r in df.select("x", "y", curves.hilbert_2d(F.col("x"), F.col("y"), 3).alias("h"), curves.morton([F.col("x"), F.col("y")], 3).alias("m")).collect()}
    path = sorted(got, key=lambda c: got[c][0])
    assert [got[c][0] for c in path] == list(range(64)) and path[0] == (0, 0) and path[-1] == (7, 0)
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:]))
    assert got[5, 3][1] == 0b011011
    cube = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cube[np.argsort(curves.hilbert_nd(cube, 3))]
    assert sorted(curves.hilbert_nd(cube, 3)) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_geodesy(spark):
    one = spark.range(1)
    metres = one.select(geodesy.haversine(13.405, 52.52, 2.3522, 48.8566)).first()[0]
    assert metres == pytest.approx(877_460, rel=1e-3)
    assert one.select(geodesy.haversine(0, 0, 180, 0)).first()[0] == pytest.approx(math.pi * geodesy.EARTH_RADIUS)
    assert one.select(geodesy.haversine_to_box(5.0, 5.0, box(0, 0, 10, 10))).first()[0] == 0
    assert [one.select(geodesy.normalise_longitude(x)).first()[0] for x in (-190.0, 180.0, 540.0, 12.5)] == [170, 180, -180, 12.5]
    assert len(geodesy.radius_boxes(179.9, 0, 50_000)) == 2 and len(geodesy.radius_boxes(0, 0, 50_000)) == 1
    assert geodesy.radius_boxes(0, 89.9, 50_000)[0][0] == -180 and geodesy.radius_boxes(0, 0, 3e7) == [(-180, -90, 180, 90)]
    with pytest.raises(ValueError):
        geodesy.radius_boxes(0, 0, -1)
