"""Files put together by hand from the published format."""

import json
import struct

import numpy as np
import pytest

from tessera.sources import flatgeobuf as fgb
from tessera.sources import wkb


def table(*fields):
    """A size-less FlatBuffers buffer of one root table. A field is None, ("n",
    format, value) for a number, or bytes of a child with a leading kind."""
    body, patches, slots = bytearray(4), [], []
    for f in fields:
        if f is None:
            slots.append(0)
            continue
        if f[0] == "n":
            size = struct.calcsize("<" + f[1])
            body += b"\0" * (-len(body) % size)
            slots.append(len(body))
            body += struct.pack("<" + f[1], f[2])
        else:
            body += b"\0" * (-len(body) % 4)
            slots.append(len(body))
            patches.append((len(body), f))
            body += b"\0" * 4
    vtable = struct.pack(f"<HH{len(slots)}H", 4 + 2 * len(slots), len(body), *slots)
    at = 4 + len(vtable) + (-(4 + len(vtable)) % 8)
    out = bytearray(struct.pack("<I", at) + vtable + b"\0" * (at - 4 - len(vtable))) + body
    struct.pack_into("<i", out, at, at - 4)
    for place, f in patches:
        out += b"\0" * (-(len(out) + 4) % 8)
        target = len(out)
        if f[0] == "v":  # vector of numbers
            raw = np.asarray(f[2], "<" + f[1])
            out += struct.pack("<I", len(raw)) + raw.tobytes()
        elif f[0] == "s":
            out += struct.pack("<I", len(f[1])) + f[1] + b"\0"
        elif f[0] == "t":
            target = len(out) + struct.unpack_from("<I", f[1])[0]
            out += f[1]
        else:  # vector of tables
            out += struct.pack("<I", len(f[1])) + b"\0" * (4 * len(f[1]))
            for k, child in enumerate(f[1]):
                out += b"\0" * (-len(out) % 8)
                slot = target + 4 + 4 * k
                struct.pack_into("<I", out, slot, len(out) + struct.unpack_from("<I", child)[0] - slot)
                out += child
        struct.pack_into("<I", out, at + place, target - at - place)
    return bytes(out)


def sized(data):
    data += b"\0" * (-len(data) % 8)
    return struct.pack("<I", len(data)) + data


def feature(xy, name, ends=None, kind=None, parts=None):
    shape = table(ends and ("v", "u4", ends), None if parts else ("v", "f8", np.ravel(xy)), None, None, None, None, kind and ("n", "B", kind), parts and ("ts", parts))
    raw = struct.pack("<H", 0) + struct.pack("<I", len(name)) + name.encode() + struct.pack("<Hi", 1, len(name))
    return sized(table(("t", shape), ("v", "u1", np.frombuffer(raw, np.uint8))))


def file(features, kind, index=False):
    columns = [table(("s", b"name"), ("n", "B", 11)), table(("s", b"size"), ("n", "B", 5))]
    crs = table(("s", b"EPSG"), ("n", "i", 4326))
    head = table(("s", b"demo"), None, ("n", "B", kind), None, None, None, None, ("ts", columns), ("n", "Q", len(features)), ("n", "H", 16 if index else 0), ("t", crs))
    nodes = b""
    if index:
        offsets = np.concatenate(([0], np.cumsum([len(f) for f in features])))[:-1]
        leaves = [struct.pack("<4dQ", 0, 0, 1, 1, o) for o in reversed(offsets.tolist())]
        nodes = (struct.pack("<4dQ", 0, 0, 1, 1, 1) if len(leaves) > 1 else b"") + b"".join(leaves)
    return b"fgb\x03fgb\x00" + sized(head) + nodes + b"".join(features)


@pytest.mark.parametrize("index", [False, True])
def test_points(spark, tmp_path, monkeypatch, index):
    monkeypatch.setattr(fgb, "RUN", 2)
    (tmp_path / "a.fgb").write_bytes(file([feature([(i, 2 * i)], f"n{i}") for i in range(5)], 1, index))
    rows = sorted(fgb.read_flatgeobuf(spark, str(tmp_path / "a.fgb")).collect())
    assert [r.row_number for r in rows] == list(range(5))
    assert [json.loads(r.properties) for r in rows] == [{"name": f"n{i}", "size": 2} for i in range(5)]
    assert [wkb.to_geojson(wkb.decode(bytes(r.geometry)))["coordinates"] for r in rows] == [[i, 2 * i] for i in range(5)]
    head, _ = fgb.feature_offsets(str(tmp_path / "a.fgb"))
    assert (head.name, head.kind, head.count, head.crs) == ("demo", "Point", 5, "EPSG:4326")


def test_other_shapes(spark, tmp_path):
    ring, hole = [(0, 0), (9, 0), (9, 9), (0, 0)], [(2, 1), (3, 1), (3, 2), (2, 1)]
    shapes = [feature(ring + hole, "p", [4, 8], 3), feature([(0, 0), (1, 1), (5, 5), (6, 7)], "l", [2, 4], 5), feature([(1, 2), (3, 4)], "m", None, 4)]
    inner = [table(("v", "u4", [4]), ("v", "f8", np.ravel(ring)), None, None, None, None, ("n", "B", 3))]
    shapes.append(feature([], "mp", None, 6, inner))
    (tmp_path / "b.fgb").write_bytes(file(shapes, 0))
    rows = sorted(fgb.read_flatgeobuf(spark, str(tmp_path / "b.fgb")).collect())
    got = [wkb.to_geojson(wkb.decode(bytes(r.geometry))) for r in rows]
    as_lists = lambda r: [list(map(float, p)) for p in r]
    assert got[0] == {"type": "Polygon", "coordinates": [as_lists(ring), as_lists(hole)]}
    assert got[1] == {"type": "MultiLineString", "coordinates": [as_lists([(0, 0), (1, 1)]), as_lists([(5, 5), (6, 7)])]}
    assert got[2] == {"type": "MultiPoint", "coordinates": as_lists([(1, 2), (3, 4)])} and got[3] == {"type": "MultiPolygon", "coordinates": [[as_lists(ring)]]}


def test_refuses(tmp_path):
    for k, bad in enumerate((b"", b"nothing here at all", file([], 1)[:20])):
        (tmp_path / f"{k}").write_bytes(bad)
        with pytest.raises(fgb.FlatGeobufError):
            fgb.feature_offsets(str(tmp_path / f"{k}"))
