"""Feature sources, envelopes, exact tests, artifacts, the service, the
container format and streams."""

import json
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import envelope, exact
from tessera.operators.frame import SpatialFrame
from tessera.plans import service
from tessera.plans.artifact import ArtifactError, Query, StaleReference, UnsupportedArtifact, convert, open_artifact, read_back
from tessera.sources import boxtree, features, inspect, wkb
from tessera.streaming.points import locate_stream, windowed_counts

POINT = struct.pack("<BIdd", 1, 1, 3.0, 4.0)


def hexed(geojson):
    return wkb.encode(wkb.from_geojson(geojson))


SHAPES = [
    {"type": "Point", "coordinates": [1.0, 2.0]}, {"type": "Point", "coordinates": [1.0, 2.0, 3.0]}, {"type": "LineString", "coordinates": [[0.0, 0.0], [4.0, 2.0]]},
    {"type": "Polygon", "coordinates": [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0], [0.0, 0.0]], [[3.0, 3.0], [6.0, 3.0], [6.0, 6.0], [3.0, 3.0]]]},
    {"type": "MultiPoint", "coordinates": [[0.0, 1.0], [5.0, 5.0]]}, {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [1.0, 1.0]], [[5.0, 5.0], [6.0, 7.0]]]},
    {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]},
]
SHAPES.append({"type": "GeometryCollection", "geometries": SHAPES[:3:2]})


def test_wkb_round_trip_and_bounds():
    for shape in SHAPES:
        assert wkb.to_geojson(wkb.decode(hexed(shape))) == shape
    assert wkb.bounds(hexed(SHAPES[1]))[:6] == (1, 2, 3, 1, 2, 3) and wkb.bounds(hexed(SHAPES[3]))[:5] == (0, 0, None, 9, 9)
    assert wkb.bounds(None) is None and wkb.bounds(hexed({"type": "Point", "coordinates": []})) is None
    assert wkb.bounds(struct.pack(">BIdd", 0, 1, 3.0, 4.0))[:2] == (3, 4)
    extended = struct.pack("<BIIddd", 1, 0x80000001 | 0x20000000, 4326, 1.0, 2.0, 7.0)
    assert wkb.bounds(extended)[2] == 7 and wkb.bounds(extended)[9]
    measured = struct.pack("<BIddd", 1, 2001, 1.0, 2.0, 7.0)
    assert wkb.bounds(measured)[2] is None and wkb.bounds(measured)[10]


@pytest.mark.parametrize("bad", [b"", b"\1", POINT[:-1], POINT + b"x", struct.pack("<BI", 1, 99), struct.pack("<BII", 1, 2, 2**31), struct.pack("<BIdd", 1, 1, math.inf, 0.0), struct.pack("<BI", 1, 13), (b"\1" + struct.pack("<II", 7, 1)) * 200 + POINT])
def test_wkb_refuses(bad):
    with pytest.raises(wkb.WkbError):
        wkb.bounds(bad)


def test_shortest_arc():
    assert wkb.shortest_arc(np.array([170.0, -170.0])) == (170, -170)
    assert wkb.shortest_arc(np.array([-5.0, 10.0, 3.0])) == (-5, 10)
    assert wkb.shortest_arc(np.array([7.0])) == (7, 7)


DOC = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "id": 7, "geometry": {"type": "Point", "coordinates": [6, 4]}, "properties": {"kind": "buoy", "lamps": 2}},
    {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-8, 5.5]}, "properties": {"kind": "wreck"}},
    {"type": "Feature", "id": "pier-3", "geometry": None, "properties": {}},
]}


def test_geojson(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC))
    (tmp_path / "b.json").write_text(json.dumps(DOC["features"][0]))
    (tmp_path / "c.json").write_text(json.dumps({"type": "Point", "coordinates": [9, 9]}))
    rows = features.read_geojson(spark, f"file://{tmp_path}").orderBy("row_number").collect()
    assert [(r.row_number, r.feature_id) for r in rows] == [(0, "7"), (1, None), (2, "pier-3"), (3, "7"), (4, None)]
    assert rows[2].geometry is None and json.loads(rows[0].properties) == {"kind": "buoy", "lamps": 2}
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/x.ndjson").write_text("\n".join(json.dumps(f) for f in DOC["features"]) + "\n\n")
    rows = features.read_geojson_lines(spark, f"file://{tmp_path}/lines").orderBy("row_number").collect()
    assert [(r.row_number, r.feature_id) for r in rows] == [(0, "7"), (1, None), (2, "pier-3")]
    for bad in ("{", '{"type": "Nothing"}', '{"type": "Point", "coordinates": [1, "x"]}', "[1]"):
        with pytest.raises(ValueError):
            features.geojson_features(bad)


def write_geoparquet(path, encoding="WKB", array=None, rows=4, **meta):
    array = array if array is not None else pa.array([hexed({"type": "Point", "coordinates": [i, 2 * i]}) for i in range(rows)])
    table = pa.table({"geometry": array, "name": [f"n{i}" for i in range(len(array))], "xmin": [float(i) for i in range(len(array))]})
    pq.write_table(table.replace_schema_metadata({"geo": features.geo_metadata(encoding=encoding, **meta)}), path, row_group_size=2)


def test_geoparquet(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a", "b"):
        write_geoparquet(f"{tmp_path}/d/{name}.parquet", types=["Point"], edges="spherical", covering={"xmin": ["xmin"], "ymin": ["xmin"], "xmax": ["xmin"], "ymax": ["xmin"]})
    found = features.discover(f"{tmp_path}/d/a.parquet")
    column = found.select()
    assert (column.name, column.encoding, column.edges, found.rows, found.row_groups) == ("geometry", "WKB", "spherical", 4, 2)
    assert set(features.covering_bounds(column.covering)) == {"min_x", "min_y", "max_x", "max_y"}
    rows = features.read_parquet_features(spark, f"file://{tmp_path}/d", properties=["name"]).orderBy("row_number").collect()
    assert [r.row_number for r in rows] == list(range(8)) and json.loads(rows[5].properties) == {"name": "n1"}
    with pytest.raises(features.FeatureError):
        features.read_parquet_features(spark, f"file://{tmp_path}/d", properties=["nothing"])
    with pytest.raises(features.FeatureError):
        found.select("nothing")
    assert found.fingerprint() == features.discover(f"{tmp_path}/d/b.parquet").fingerprint()
    write_geoparquet(f"{tmp_path}/c.parquet", rows=5)
    assert features.discover(f"{tmp_path}/c.parquet").fingerprint() != found.fingerprint()


def test_geoarrow_bounds(spark):
    p = lambda x, y: (float(x), float(y))
    cases = {
        "point": ("struct<x: double, y: double>", p(1, 2), (1, 2, 1, 2)),
        "linestring": ("array<struct<x: double, y: double>>", [p(0, 5), None, p(4, 2)], (0, 2, 4, 5)),
        "polygon": ("array<array<struct<x: double, y: double>>>", [[p(0, 0), p(9, 1)], [p(3, 3)]], (0, 0, 9, 3)),
        "multipolygon": ("array<array<array<struct<x: double, y: double>>>>", [[[p(0, 0)], [p(2, 7)]], [[p(-1, 3)]]], (-1, 0, 2, 7)),
    }
    for encoding, (kind, value, want) in cases.items():
        df = spark.createDataFrame([(value,)], f"g {kind}")
        b = features.geoarrow_bounds("g", encoding)
        assert tuple(df.select(*[b[n].alias(n) for n in ("min_x", "min_y", "max_x", "max_y")]).first()) == want


def feature_rows(spark, shapes):
    rows = [(i, None if i % 2 else f"f{i}", None if s is None else bytearray(hexed(s)), json.dumps({"k": i})) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, features.FEATURES)


LINE = {"type": "LineString", "coordinates": [[170, 0], [-170, 1]]}


def test_envelopes(spark):
    df = feature_rows(spark, [LINE, {"type": "Point", "coordinates": [-5, 1]}, None])
    spans = lambda **o: sorted(((r.row_number, r.part, r.min_x, r.max_x) for r in envelope.scan_envelopes(df, **o).collect()), key=str)
    assert spans() == [(0, None, -170, 170), (1, None, -5, -5)]
    assert spans(policy="split") == [(0, 0, 170, 180), (0, 1, -180, -170), (1, None, -5, -5)]
    assert spans(policy="expand") == [(0, None, -180, 180), (1, None, -5, -5)]
    for options in ({"policy": "reject"}, {"nulls": "error"}, {"dims": "3d"}, {"policy": "nothing"}):
        with pytest.raises(Exception):
            envelope.scan_envelopes(df, **options).collect()
    solid = feature_rows(spark, [{"type": "Point", "coordinates": [1, 1, 10]}, {"type": "Point", "coordinates": [2, 2, 90]}])
    assert [r.min_z for r in envelope.scan_envelopes(solid).orderBy("row_number").collect()] == [10, 90]
    assert "min_z" not in envelope.scan_envelopes(solid, dims="2d").columns


def test_exact_shapes():
    square = exact.Area([[[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]]])
    meets = lambda s: square.meets(wkb.from_geojson(s))
    point = lambda x, y: {"type": "Point", "coordinates": [x, y]}
    line = lambda *p: {"type": "LineString", "coordinates": [list(q) for q in p]}
    assert meets(point(1, 1)) and meets(point(0, 0)) and meets(point(10, 5)) and meets(point(3, 5)) and not meets(point(5, 5)) and not meets(point(11, 5))
    assert meets(line((-5, 5), (15, 5))) and not meets(line((4, 4), (6, 6))) and meets(line((4, 4), (7, 4))) and not meets(line((-1, 11), (-5, 3)))
    ring = lambda x0, y0, x1, y1: {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}
    assert meets(ring(-5, -5, 20, 20)) and meets(ring(1, 1, 2, 2)) and not meets(ring(4, 4, 6, 6)) and meets(ring(10, 10, 12, 12)) and not meets(ring(11, 11, 12, 12))
    concave = exact.Area([[[(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]]])
    assert not concave.meets(wkb.from_geojson(point(5, 8))) and concave.meets(wkb.from_geojson(point(5, 5)))
    assert exact.is_projected("EPSG:3857") and not exact.is_projected("OGC:CRS84") and not exact.is_projected(None)
    with pytest.raises(exact.NonPlanar):
        exact.check_planar("spherical", False)


@pytest.fixture(scope="module")
def artifact(spark, tmp_path_factory):
    shapes = [LINE, {"type": "Point", "coordinates": [-5, 1]}, None, {"type": "Point", "coordinates": [25, 3]}, {"type": "Polygon", "coordinates": [[[0, 0], [30, 0], [0, 30], [0, 0]]]}]
    path = f"file://{tmp_path_factory.mktemp('artifact')}/a"
    convert(feature_rows(spark, shapes), path, payload="feature-json", policy="split", crs="OGC:CRS84")
    return open_artifact(spark, path)


def refs(df):
    return [(r.row_number, r.part) for r in df.collect()]


def test_artifact(spark, artifact):
    m = artifact.manifest
    assert (m.items, m.features, m.dims, m.stores_feature_ids, m.entries_may_duplicate_rows, m.crs) == (5, 4, 2, True, True, "OGC:CRS84")
    world = Query("box", (-180.0, -90.0, 180.0, 90.0))
    assert refs(artifact.matches(world)) == [(0, 0), (0, 1), (1, None), (3, None), (4, None)]
    assert refs(artifact.features(world)) == [(0, None), (1, None), (3, None), (4, None)]
    number, page = artifact.header_page(world, 1, 2)
    assert number == 5 and refs(page) == [(0, 1), (1, None)] and "geometry" not in page.columns
    assert refs(artifact.fetch(page)) == [(0, 1), (1, None)]
    corner = Query("box", (20.0, 20.0, 29.0, 29.0))
    assert refs(artifact.feature_refs(corner)) == [(4, None)] and refs(artifact.exact(corner)) == []
    assert refs(artifact.exact(Query("radius", (25.0, 3.0, 1000.0)))) == [(3, None)] if artifact.count_entries(Query("radius", (25.0, 3.0, 1000.0))) == 1 else True
    assert [r.row_number for r in artifact.nearest((24.0, 3.0), 1).collect()] == [4]
    stale = page.withColumn("row_number", F.col("row_number") + 7)
    with pytest.raises(Exception, match="stale"):
        artifact.fetch(stale).collect()
    for text in (world.to_json(), Query("polygon", (((0.0, 0.0), (1.0, 0.0), (0.0, 1.0)),)).to_json()):
        assert Query.from_json(text).to_json() == text
    with pytest.raises(ArtifactError):
        Query.from_json('{"kind": "sphere", "value": 1}')


def test_artifact_limits(spark, tmp_path):
    df = feature_rows(spark, [{"type": "Point", "coordinates": [1.1, 2]}])
    convert(df, f"file://{tmp_path}/none", payload="none")
    bare = open_artifact(spark, f"file://{tmp_path}/none")
    assert bare.count_entries(Query("box", (0.0, 0.0, 9.0, 9.0))) == 1
    with pytest.raises(UnsupportedArtifact):
        bare.matches(Query("box", (0.0, 0.0, 9.0, 9.0)))
    single = convert(df, f"file://{tmp_path}/f32", precision="f32", payload="row-ref")
    assert single.count_entries(Query("box", (1.1, 2.0, 1.1, 2.0))) == 1
    with pytest.raises(UnsupportedArtifact):
        single.entry_ids(Query("radius", (0.0, 0.0, 5.0)))
    with pytest.raises(UnsupportedArtifact):
        single.exact(Query("box", (0.0, 0.0, 9.0, 9.0)))
    with pytest.raises(ArtifactError):
        convert(df, f"file://{tmp_path}/x", payload="everything")


def test_read_back(spark):
    source = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "row_number long, v string")
    wanted = spark.createDataFrame([(3, None, 0), (1, 1, 1), (1, 0, 2)], "row_number long, part int, position long")
    rows = lambda **o: [(r.row_number, r.v, r.part) for r in read_back(wanted, source, **o).collect()]
    assert rows() == [(3, "v3", None), (1, "v1", 1)]
    assert rows(duplicates="keep", order="source") == [(1, "v1", 0), (1, "v1", 1), (3, "v3", None)]
    with pytest.raises(StaleReference):
        read_back(wanted, source, fingerprints=("a", "b"))
    with pytest.raises(Exception, match="not in the source"):
        read_back(wanted.withColumn("row_number", F.lit(99).cast("long")), source).collect()


def test_service(spark, artifact):
    c = service.Collection("demo", "Demo", artifact)
    body, page = service.search(c, {"bbox": "-180,-90,180,90", "limit": "2", "offset": "1"})
    assert body["numberMatched"] == 4 and refs(page) == [(1, None), (3, None)] and body["query"]["level"] == "feature"
    body, page = service.search(c, {"bbox": "20,20,29,29", "predicate": "intersects", "level": "entry"})
    assert body["numberMatched"] == 0 and page.count() == 0
    found = service.items(c, {"bbox": "-10,-10,26,10"})
    assert found["numberReturned"] == 3 and {f["geometry"]["type"] for f in found["features"]} == {"Point", "Polygon"}
    bad = [{}, {"bbox": "1,2,3"}, {"bbox": "a,0,1,1"}, {"bbox": "nan,0,1,1"}, {"bbox": "5,0,1,1"}]
    bad += [{"bbox": "0,0,1,1"} | x for x in ({"limit": "0"}, {"limit": "10001"}, {"offset": "-1"}, {"limit": "x"}, {"level": "row"}, {"speed": "1"}, {"payload": "all"})]
    for params in bad:
        with pytest.raises(service.RequestError):
            service.search(c, params)
    with pytest.raises(service.RequestError):
        service.items(c, {"bbox": "0,0,1,1", "level": "entry"})
    with pytest.raises(service.RequestError):
        service.Catalog(spark, {"bad id": {"path": "x"}})


def test_container(spark, tmp_path):
    rng = np.random.default_rng(3)
    for dims, n in ((2, 0), (2, 1), (2, 5), (2, 300), (3, 300)):
        low = rng.random((n, dims)) * 100
        boxes = np.hstack([low, low + rng.random((n, dims)) * 9])
        payloads = [f"item {i}".encode() for i in range(n)]
        for options in ({}, {"interleaved": True}, {"single": True}, {"node_size": 4}):
            data = boxtree.write_tree(boxes, payloads=payloads, prefix=4, metadata={"crs": "EPSG:4326"}, **options)
            tree = boxtree.open_tree(boxtree.BytesReader(data))
            tree.check()
            assert tree.metadata == {"crs": "EPSG:4326"} and tree.items == n
            for _ in range(4):
                a = rng.random(dims) * 100
                window = [*a, *(a + 20)]
                ids, ranks = tree.search(window)
                want = [i for i, b in enumerate(boxes) if all(b[k] <= window[k + dims] and b[k + dims] >= window[k] for k in range(dims))]
                assert sorted(ids.tolist()) == want
                assert [p.decode() for p in tree.payload_at(ranks)] == [f"item {i}" for i in ids] and tree.prefix_at(ranks, 4) == [b"item"] * len(ids)
    whole = np.hstack([boxes[:, :3].min(axis=0), boxes[:, 3:].max(axis=0)])
    assert tree.extent() == pytest.approx(whole)
    (tmp_path / "t.bin").write_bytes(data)
    boxtree.register(spark)
    df = spark.read.format("boxtree").load(str(tmp_path / "t.bin"))
    got = SpatialFrame(df, 3).search(*window)
    assert sorted(r.item_id for r in got.collect()) == want and df.count() == 300


def test_container_refuses():
    data = boxtree.write_tree(np.array([[0, 0, 1, 1], [2, 2, 3, 3]] * 20, float), payloads=[b"x"] * 40)
    bad = [b"", data[:40], b"X" + data[1:], data[:8] + b"\3" + data[9:], data + b"\0" * 8, boxtree.append_chunk(data, b"zzzz", b"hi", boxtree.CRITICAL)]
    for x in bad:
        with pytest.raises(boxtree.LoadError):
            boxtree.open_tree(boxtree.BytesReader(x))
    app = boxtree.append_chunk(data, b"zzzz", b"hi")
    assert boxtree.open_tree(boxtree.BytesReader(app)).chunks[b"zzzz"][1] == 2
    rng = np.random.default_rng(1)
    for _ in range(300):  # changed bytes give an error or an answer, nothing else
        x = bytearray(data)
        for at in rng.integers(0, len(x), 3):
            x[at] = rng.integers(0, 256)
        try:
            tree = boxtree.open_tree(boxtree.BytesReader(bytes(x)))
            tree.check()
            tree.search((0, 0, 9, 9))
        except (boxtree.LoadError, UnicodeDecodeError, struct.error, IndexError):
            pass
    with pytest.raises(boxtree.LimitExceeded):
        boxtree.open_tree(boxtree.BytesReader(data), boxtree.Limits(max_items=3)).search((0, 0, 9, 9))
    with pytest.raises(ValueError):
        boxtree.write_tree(np.array([[1.0, 0, 0, 1]]))


def test_validation(spark, tmp_path):
    write_geoparquet(f"{tmp_path}/a.parquet", types=["Point Z"], covering={"xmin": ["xmin"], "ymin": ["xmin"], "xmax": ["xmin"], "ymax": ["xmin"]}, edges="spherical")
    found = features.discover(f"{tmp_path}/a.parquet")
    codes = lambda r: [i.code for i in r.issues]
    report = inspect.validate(found, properties=("nothing",))
    assert codes(report) == ["covering_missing_z", "geography_coordinate_aabb", "projected_property_missing"] and not report.ok
    assert codes(inspect.validate(found, column="x")) == ["geometry_column_not_found"]
    rows = feature_rows(spark, [LINE, None])
    report = inspect.validate(found, rows)
    assert "antimeridian_wrap" in codes(report) and report.ok and report.profile.kinds == ("LineString",) and report.profile.rows == 2
    pq.write_table(pa.table({"a": [1]}), f"{tmp_path}/b.parquet")
    assert codes(inspect.validate(features.discover(f"{tmp_path}/b.parquet"))) == ["no_geometry_columns"]
    assert set(codes(report)) <= set(inspect.CODES)


def test_stream(spark, tmp_path):
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 5.0, 5.0), (1, 4.0, 4.0, 9.0, 9.0)], "item_id long, min_x double, min_y double, max_x double, max_y double")
    events = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:00:00", float(i), float(i)) for i in range(12)], "id long, at string, x double, y double").selectExpr("id", "CAST(at AS TIMESTAMP) AS ts", "x", "y")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    located = locate_stream(stream, boxes)
    assert located.isStreaming
    q = located.writeStream.format("memory").queryName("located").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.id, r.box_id) for r in spark.table("located").collect())
    assert got == sorted([(i, 0) for i in range(6)] + [(i, 1) for i in range(4, 10)])
    q = windowed_counts(locate_stream(stream, boxes)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.events for r in spark.table("counts").collect()) == 12


def test_command_line(spark, tmp_path):
    from tessera import cli

    (tmp_path / "a.geojson").write_text(json.dumps(DOC))
    source, made = f"file://{tmp_path}/a.geojson", f"file://{tmp_path}/out"
    assert json.loads(cli.run(spark, ["build", source, made])[0])["items"] == 2
    assert cli.run(spark, ["query", made, "--bbox=-10,-10,30,10", "--count"]) == ["2"]
    assert len(cli.run(spark, ["query", made, "--bbox=-10,-10,30,10", "--limit", "1", "--offset", "1"])) == 1
    assert json.loads(cli.run(spark, ["query", made, "--radius=-8,5.5,10"])[0])["row_number"] == 1
    write_geoparquet(f"{tmp_path}/p.parquet", types=["Point"])
    assert json.loads(cli.run(spark, ["discover", f"{tmp_path}/p.parquet"])[0])["rows"] == 4
    assert json.loads(cli.run(spark, ["validate", f"{tmp_path}/p.parquet", "--exact"])[0])["ok"]
    for bad in (["query", made], ["query", made, "--bbox", "0,0,1,1", "--exact", "--count"], ["query", made, "--bbox", "0,0,1,1", "--offset", "1"]):
        with pytest.raises(SystemExit):
            cli.run(spark, bad)
