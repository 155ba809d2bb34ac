import struct

import numpy as np
import pytest

from tessera.sources import records


def test_references(spark):
    rows = [(123, None, None, None, None), (2**40, 7, 9, 1, bytearray(b"{}"))]
    df = spark.createDataFrame(rows, "row_number long, row_group long, row_in_group long, part int, body binary")
    coded = df.select(records.encode_reference(*df.columns).alias("p"))
    got = [bytes(r.p) for r in coded.collect()]
    assert got == [struct.pack("<QIIHHI", 123, 2**32 - 1, 2**32 - 1, 2**16 - 1, 0, 0), struct.pack("<QIIHHI", 2**40, 7, 9, 1, 0, 0) + b"{}"]
    back = coded.select(records.decode_reference("p").alias("r"), records.reference_body("p").alias("b")).collect()
    assert [tuple(r.r) for r in back] == [(123, None, None, None), (2**40, 7, 9, 1)] and bytes(back[1].b) == b"{}"
    bad = spark.createDataFrame([(bytearray(b"short"),), (bytearray(b"\1" * 24),), (None,)], "p binary")
    assert [tuple(r.r) for r in bad.select(records.decode_reference("p").alias("r")).collect()] == [(None,) * 4] * 3


def test_triangles():
    corners = np.arange(18, dtype=float).reshape(2, 9)
    for single, size in ((False, 72), (True, 36)):
        raw = records.triangles_to_bytes(corners, single)
        assert [len(r) for r in raw] == [size, size] and (records.triangles_from_bytes(raw, 3, single) == corners).all()
    with pytest.raises(ValueError):
        records.triangles_from_bytes([b"x"], 2)


def test_projection():
    columns = ["geometry", "a", "b"]
    assert records.projected_properties(columns, "geometry") == ["a", "b"] and records.projected_properties(columns, "geometry", "none") == []
    assert records.projected_properties(columns, "geometry", "exclude", ["a"]) == ["b"] and records.projected_properties(columns, "geometry", "include", ["b"]) == ["b"]
    with pytest.raises(ValueError):
        records.projected_properties(columns, "geometry", "include", ["c"])
