"""What works on whole batches gives what it gives row by row."""

import itertools
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.rays import Ray
from tessera.functions.regions import AnyRegion, BoxRegion, ConvexPolygon, Frustum
from tessera.operators.exact import Area, intersects, within_radius
from tessera.operators.frame import SpatialFrame
from tessera.plans.artifact import Query, UnsupportedArtifact, convert
from tessera.sources import wkb
from tessera.sources.boxtree import BytesReader, open_tree, write_tree

POINT = struct.pack("<BIdd", 1, 1, 4.0, 5.0)
OTHERS = [
    None,
    struct.pack(">BIdd", 0, 1, 6.0, 1.0),
    struct.pack("<BIdd", 1, 1, np.nan, np.nan),
    struct.pack("<BIddd", 1, 1001, 9.0, 9.0, 3.0),
    wkb.encode(wkb.from_geojson({"type": "LineString", "coordinates": [[170, 0], [-170, 5]]})),
    wkb.encode(wkb.from_geojson({"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 0]]]})),
    wkb.encode(wkb.from_geojson({"type": "MultiPoint", "coordinates": [[-3, -3], [4, 4]]})),
]


@pytest.mark.parametrize("batch", [[POINT] * 3, OTHERS, [POINT, *OTHERS, POINT], [], [None]])
def test_bounds_of_mixed_batches(batch):
    found = wkb.wkb_bounds.func(pd.Series(batch, dtype=object))
    plain = lambda v: None if v is None or v != v else v
    got = [tuple(map(plain, r)) for r in found[wkb.BOUNDS.names].itertuples(index=False)]
    assert got == [wkb.bounds(x) or (None,) * len(wkb.BOUNDS) for x in batch]


def test_arcs_of_many_lines():
    dice = np.random.default_rng(2)
    lines = [dice.integers(-18, 19, (dice.integers(2, 7), 2)) * 10 for _ in range(300)] + [np.array([[-180, 0], [180, 0]]), np.array([[5, 5], [5, 5]])]
    raw = [wkb.encode(wkb.from_geojson({"type": "LineString", "coordinates": c.tolist()})) for c in lines]
    got = wkb.bounds_of_many(raw)
    assert [tuple(r) for r in got.itertuples(index=False)] == [wkb.bounds(x) for x in raw]


def test_area_takes_many_at_once(spark):
    area = Area([[[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]], [[(20, 20), (30, 20), (25, 30)]]])
    dice = np.random.default_rng(4)
    shapes = []
    for _ in range(150):
        x, y, a, b = dice.integers(-4, 34, 4).tolist()
        w, h = dice.integers(0, 9, 2).tolist()
        shapes += [
            {"type": "Point", "coordinates": [x, y]},
            {"type": "LineString", "coordinates": [[x, y], [a, b]]},
            {"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]},
            {"type": "MultiPoint", "coordinates": [[x, y], [a, b]]},
            {"type": "MultiLineString", "coordinates": []},
        ]
    decoded = [wkb.from_geojson(s) for s in shapes]
    one = [area.meets(g) for g in decoded]
    assert area.meets_each(decoded).tolist() == one and 0 < sum(one) < len(one)
    raw = [wkb.encode(g) for g in decoded] + [None]
    df = spark.createDataFrame(list(enumerate(raw)), "id long, g binary").repartition(1)
    assert {r.id for r in df.filter(intersects(F.col("g"), area)).collect()} == {k for k, m in enumerate(one) if m}
    boxes = np.array([[x, y, x + 2, y + 3] for x, y in itertools.product(range(-4, 34), repeat=2)], float)
    ring = lambda b: [[b[0], b[1]], [b[2], b[1]], [b[2], b[3]], [b[0], b[3]], [b[0], b[1]]]
    want = [area.meets(wkb.from_geojson({"type": "Polygon", "coordinates": [ring(b)]})) for b in boxes.tolist()]
    assert area.meets_boxes(*boxes.T).tolist() == want
    # On whole numbers the square with its hole is told by comparisons.
    at = np.array(list(itertools.product(range(-2, 13), repeat=2)), float)
    inside = ((at >= 0) & (at <= 10)).all(axis=1) & ~((at > 3) & (at < 7)).all(axis=1)
    assert area.holds(at).tolist() == inside.tolist()


def test_radius_of_points_and_multipoints(spark):
    raw = [POINT, OTHERS[-1], None, wkb.encode(wkb.from_geojson({"type": "MultiPoint", "coordinates": []})), OTHERS[1]]
    df = spark.createDataFrame(list(enumerate(raw)), "id long, g binary").repartition(1)
    assert {r.id for r in df.filter(within_radius(F.col("g"), 4.0, 4.5, 60_000)).collect()} == {0, 1}


def test_trees_by_region_and_payloads():
    dice = np.random.default_rng(9)
    low = dice.integers(0, 100, (700, 2)).astype(float)
    boxes = np.hstack([low, low + dice.integers(0, 6, (700, 2))])
    blobs = [bytes([k % 251]) * (k % 5) for k in range(700)]
    tree = open_tree(BytesReader(write_tree(boxes, payloads=blobs, interleaved=True)))
    corners = [(10.0, 10.0), (80.0, 20.0), (40.0, 90.0)]
    cross = lambda b: [
        all((x - px) * (qy - py) - (y - py) * (qx - px) > 0 for x in b[::2] for y in b[1::2])
        for (px, py), (qx, qy) in zip(corners, corners[1:] + corners[:1])
    ]
    around = (boxes[:, 0] <= 80) & (boxes[:, 2] >= 10) & (boxes[:, 1] <= 90) & (boxes[:, 3] >= 10)
    triangle = {k for k, b in enumerate(boxes.tolist()) if around[k] and not any(cross(b))}
    window = {k for k, b in enumerate(boxes.tolist()) if b[0] <= 99 and b[2] >= 90 and b[1] <= 9 and b[3] >= 0}
    ids, ranks = tree.search_region(AnyRegion([ConvexPolygon(corners), BoxRegion(90, 0, 99, 9)]))
    assert sorted(ids.tolist()) == sorted(triangle | window)
    assert tree.payload_at([*ranks, *ranks[::-1]]) == [blobs[i] for i in [*ids, *ids[::-1]]] and tree.payload_at([]) == []
    assert not len(tree.search_region(ConvexPolygon(corners[:2]))[0])
    with pytest.raises(IndexError):
        tree.payload_at([700])
    cubes = np.hstack([np.zeros((40, 3)), np.ones((40, 3))]) + np.arange(40)[:, None]
    planes = [(1, 0, 0, -5), (-1, 0, 0, 9), (0, 1, 0, 0), (0, -1, 0, 90), (0, 0, 1, 0), (0, 0, -1, 90)]
    found, _ = open_tree(BytesReader(write_tree(cubes, node_size=4))).search_region(Frustum(planes))
    assert sorted(found.tolist()) == list(range(4, 10))


def test_rounded_boxes_narrow_and_exact_ones_rank(spark):
    rows = [(k, 0.1 * (k % 9), 0.1 * (k % 5)) for k in range(60)]
    exact = SpatialFrame.from_points(spark.createDataFrame(rows, "item_id long, x double, y double"), ["x", "y"], curve=None)
    single = exact.to_single()
    for k, most in ((7, None), (100, None), (9, 0.15), (5, -1.0)):
        want = [r.item_id for r in exact.neighbors((0.33, 0.21), k, most).collect()]
        assert [r.item_id for r in single.neighbors_exact(exact, (0.33, 0.21), k, most).collect()] == want
    assert single.neighbors_exact(exact, (float("nan"), 0.0), 3).isEmpty()
    seen = []
    assert single.visit_exact(exact, lambda r: seen.append(r.item_id) or len(seen) == 2, 0.0, 0.0, 0.5, 0.5) and len(seen) == 2


def test_artifacts_refuse_rays_they_cannot_answer(spark, tmp_path):
    features = spark.createDataFrame([(0, "a", POINT)], "row_number long, feature_id string, geometry binary")
    ray, deep = Ray((0.0, 1.0), (1.0, 1.0), 50.0), Ray((0.0, 1.0, 0.0), (1.0, 1.0, 0.0), 50.0)
    double = convert(features, f"file://{tmp_path}/double", payload="row-ref")
    assert [(r.row_number, r.t) for r in double.raycast_closest(ray).collect()] == [(0, 4.0)]
    with pytest.raises(UnsupportedArtifact):
        double.raycast(deep)
    single = convert(features, f"file://{tmp_path}/single", payload="none", precision="f32")
    with pytest.raises(UnsupportedArtifact):
        single.raycast(ray)
    assert [tuple(r) for r in single.payload_headers(Query("box", (0.0, 0.0, 9.0, 9.0))).collect()] == [(0, 0)]
