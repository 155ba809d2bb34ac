"""Each kind of source from its metadata to an artifact, with projected properties."""

import json
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_flatgeobuf import feature, file

from tessera import cli
from tessera.plans.artifact import convert, open_artifact
from tessera.sources import features, flatgeobuf, inspect, records, wkb

POINTS = [(10.5, -3.0), (11.0, 4.25), (150.0, 60.0)]


class Wkb(pa.ExtensionType):
    """Written as Parquet's own geometry type."""

    def __init__(self):
        super().__init__(pa.binary(), "geoarrow.wkb")

    def __arrow_ext_serialize__(self):
        return b"{}"

    @classmethod
    def __arrow_ext_deserialize__(cls, storage, raw):
        return cls()


def point(x, y):
    return struct.pack("<BIdd", 1, 1, x, y)


def collection(path):
    shapes = [{"type": "Feature", "id": f"p{k}", "geometry": {"type": "Point", "coordinates": list(xy)}, "properties": {"depth": k, "kind": "buoy", "more": [k]}} for k, xy in enumerate(POINTS)]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))


def test_flatgeobuf_in_the_command_line(spark, tmp_path):
    (tmp_path / "a.fgb").write_bytes(file([feature([xy], f"n{k}") for k, xy in enumerate(POINTS)], 1, True))
    source, made = f"{tmp_path}/a.fgb", f"file://{tmp_path}/a"
    found = json.loads(cli.run(spark, ["discover", source])[0])
    assert found["rows"] == 3 and found["columns"][0]["geometry_types"] == ["Point"] and found["columns"][0]["crs"] == "EPSG:4326"
    assert found["schema"] == [["geometry", "geometry"], ["name", "string"], ["size", "int"]]
    assert json.loads(cli.run(spark, ["validate", source, "--exact"])[0]) == {"ok": True, "issues": []}
    assert json.loads(cli.run(spark, ["build", source, made, "--payload", "feature-json", "--include", "name"])[0])["items"] == 3
    got = [json.loads(r.properties) for r in sorted(spark.read.parquet(f"{made}/entries").collect(), key=lambda r: r.row_number)]
    assert got == [{"name": f"n{k}"} for k in range(3)]
    assert cli.run(spark, ["query", made, "--bbox=10,-5,12,5", "--count"]) == ["2"]


def test_count_that_the_header_leaves_open(tmp_path):
    raw = file([feature([xy], "n") for xy in POINTS], 1)
    (tmp_path / "b.fgb").write_bytes(raw.replace(struct.pack("<Q", 3), struct.pack("<Q", 0), 1))
    assert flatgeobuf.discover_flatgeobuf(f"{tmp_path}/b.fgb").rows == 3


def test_geojson_is_discovered(spark, tmp_path):
    collection(tmp_path / "c.geojson")
    found = json.loads(cli.run(spark, ["discover", f"file://{tmp_path}/c.geojson"])[0])
    assert (found["rows"], found["primary"], found["columns"][0]["geometry_types"]) == (3, "geometry", ["Point"])
    assert [n for n, _ in found["schema"]] == ["geometry", "depth", "kind", "more"]
    (tmp_path / "none.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    assert json.loads(cli.run(spark, ["discover", f"file://{tmp_path}/none.geojson"])[0])["rows"] == 0


@pytest.mark.parametrize(
    "projection,want", [(("all", ()), {"depth", "kind", "more"}), (("none", ()), set()), (("include", ["kind", "gone"]), {"kind"}), (("exclude", ["kind"]), {"depth", "more"})]
)
def test_projection_in_convert(spark, tmp_path, projection, want):
    collection(tmp_path / "c.geojson")
    rows = features.read_geojson(spark, f"file://{tmp_path}/c.geojson")
    convert(rows, f"file://{tmp_path}/out", "feature-json", properties=projection[0], names=projection[1])
    got = spark.read.parquet(f"file://{tmp_path}/out/entries").collect()
    assert len(got) == 3 and all(set(json.loads(r.properties)) == want for r in got)
    assert open_artifact(spark, f"file://{tmp_path}/out").manifest.items == 3


def test_projection_of_odd_rows(spark):
    df = spark.createDataFrame([(0, None, None, None), (1, "a", None, "{}"), (2, "b", None, '{"a": null, "b": "é"}')], features.FEATURES)
    got = {r.row_number: r.properties for r in records.project_properties(df, "include", ["a", "b"]).collect()}
    assert got[0] is None and json.loads(got[1]) == {} and json.loads(got[2]) == {"a": None, "b": "é"}
    assert [r.properties for r in records.project_properties(df, "none").orderBy("row_number").collect()] == [None, "{}", "{}"]
    assert records.project_properties(df.limit(0), "exclude", ["a"]).collect() == []
    with pytest.raises(ValueError):
        records.project_properties(df, "some")


def at(*xy):
    return dict(zip("xyz", map(float, xy)))


GEOARROW = {
    "point": [at(1, 2), None],
    "linestring": [[at(0, 5), at(4, 2)], []],
    "multipoint": [[at(1, 1), at(2, 3)], None],
    "polygon": [[[at(0, 0), at(9, 0), at(9, 9), at(0, 0)], [at(5, 1), at(6, 1), at(6, 2), at(5, 1)]], None],
    "multilinestring": [[[at(0, 0), at(1, 1)], [at(5, 5), at(6, 7)]], []],
    "multipolygon": [[[[at(0, 0), at(1, 0), at(1, 1), at(0, 0)]], [[at(5, 5), at(6, 5), at(6, 6), at(5, 5)]]], None],
}


def nested(value):
    return list(value.values()) if isinstance(value, dict) else None if value is None else [nested(v) for v in value]


@pytest.mark.parametrize("interleaved", [False, True])
@pytest.mark.parametrize("encoding", GEOARROW)
def test_geoarrow_to_wkb(spark, encoding, interleaved, tmp_path):
    leaf = pa.list_(pa.float64(), 2) if interleaved else pa.struct([("x", pa.float64()), ("y", pa.float64())])
    for _ in range(features.DEPTH[encoding]):
        leaf = pa.list_(leaf)
    values = GEOARROW[encoding]
    shown = [nested(v) for v in values] if interleaved else values
    pq.write_table(pa.table({"g": pa.array(shown, leaf), "n": [1, 2]}), f"{tmp_path}/g.parquet")
    rows = features.read_parquet_features(spark, f"file://{tmp_path}/g.parquet", "g", encoding=encoding).orderBy("row_number").collect()
    assert wkb.to_geojson(wkb.decode(bytes(rows[0].geometry))) == {"type": features.GEOARROW_KINDS[encoding], "coordinates": nested(values[0])}
    assert rows[1].geometry is None if values[1] is None else wkb.decode(bytes(rows[1].geometry)).is_empty


def test_geoarrow_with_heights_is_built(spark, tmp_path):
    leaf = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]))
    table = pa.table({"road": pa.array([[at(0, 1, 7), None, at(3, 4, 9)], None], leaf), "lanes": [2, 3], "name": ["a", "b"]})
    pq.write_table(table.replace_schema_metadata({b"geo": features.geo_metadata("road", "linestring", ["LineString Z"])}), f"{tmp_path}/r.parquet")
    made = f"file://{tmp_path}/roads"
    report = json.loads(cli.run(spark, ["build", f"{tmp_path}/r.parquet", made, "--payload", "feature-json", "--exclude", "lanes"])[0])
    assert (report["dims"], report["items"], report["extent"]) == (3, 1, [0, 1, 7, 3, 4, 9])
    assert json.loads(spark.read.parquet(f"{made}/entries").first().properties) == {"name": "a"}
    with pytest.raises(ValueError):
        cli.run(spark, ["build", f"{tmp_path}/r.parquet", f"{made}2", "--include", "gone"])


def native(path, points, statistics=True):
    pa_type = Wkb()
    pa.register_extension_type(pa_type)
    try:
        shapes = pa.ExtensionArray.from_storage(pa_type, pa.array([None if p is None else point(*p) for p in points], pa.binary()))
        pq.write_table(pa.table({"g": shapes, "n": list(range(len(points)))}), path, row_group_size=2, write_statistics=statistics)
    finally:
        pa.unregister_extension_type("geoarrow.wkb")


def test_native_row_groups(tmp_path):
    native(f"{tmp_path}/n.parquet", [*POINTS, (-170.0, 1.0), None])
    found = features.discover(f"{tmp_path}/n.parquet")
    assert found.select().native
    assert [(g.row_group, g.rows, g.bounds) for g in found.groups] == [(0, 2, (10.5, -3.0, 11.0, 4.25)), (1, 2, (-170.0, 1.0, 150.0, 60.0)), (2, 1, None)]
    assert found.groups[0].kinds == (1,) and found.groups[0].heights is None and not any(g.crossing for g in found.groups)
    codes = [i.code for i in inspect.validate(found).issues]
    assert "missing_native_geo_stats" in codes and "antimeridian_wrap" not in codes
    native(f"{tmp_path}/whole.parquet", POINTS[:2])
    assert "missing_native_geo_stats" not in [i.code for i in inspect.validate(features.discover(f"{tmp_path}/whole.parquet")).issues]


def test_native_groups_that_cross(tmp_path):
    native(f"{tmp_path}/n.parquet", POINTS[:2])
    found = features.discover(f"{tmp_path}/n.parquet")
    own = features.GroupBounds("g", 0, 2, (170.0, 0.0, -170.0, 1.0))
    crossing = features.Discovery(found.columns, found.primary, 2, 1, found.schema, groups=(own,))
    assert own.crossing and "antimeridian_wrap" in [i.code for i in inspect.validate(crossing).issues]
    assert inspect.validate(crossing).ok
