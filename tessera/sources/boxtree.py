"""The packed box-tree container: reading, range reading and writing.

A file is a superblock, a directory of chunks, and chunks TREE (boxes in levels,
leaves first, ordered along a Hilbert curve), PYLD (one blob for each item, in
leaf order), PFIX (the first bytes of every blob) and META (short texts).
Application chunks have lower-case tags and may follow. Numbers are
little-endian. Everything that a file claims is checked before it is used.

`register` makes the format readable as `spark.read.format("boxtree")`, one
partition for each run of leaves; comparisons of bounds that Spark pushes down
skip runs whose parent boxes can't match.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import BinaryIO, Protocol

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.boxes import box_names
from tessera.functions.curves import hilbert_nd
from tessera.functions.single import down, up

# The format's magic, version, tags and field numbers.
MAGIC = b"PSINDEX\0"
VERSION = 2
META_FIELDS = {0: "crs", 1: "content_type", 2: "attribution"}
KNOWN = {b"TREE", b"PYLD", b"PFIX", b"META"}
CRITICAL = 1


class LoadError(ValueError):
    pass


class LimitExceeded(RuntimeError):
    pass


@dataclass
class Limits:
    """What one range-read search may cost; None is no limit."""

    max_reads: int | None = None
    max_bytes: int | None = None
    max_items: int | None = None
    gap_bytes: int = 4096


class RangeReader(Protocol):
    def size(self) -> int: ...

    def read(self, at: int, n: int) -> bytes: ...


class BytesReader:
    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > len(self.data):
            raise LoadError("a range lies outside the file")
        return self.data[at : at + n]


class FileReader:
    def __init__(self, path: str):
        self.file: BinaryIO = open(path.removeprefix("file://"), "rb")  # noqa: SIM115
        self.length = self.file.seek(0, 2)

    def size(self) -> int:
        return self.length

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.length:
            raise LoadError("a range lies outside the file")
        self.file.seek(at)
        return self.file.read(n)


def level_ends(items: int, node_size: int) -> list[int]:
    """Where each level's nodes end; the last is the number of nodes."""
    if not items:
        return [0]
    ends, width = [items], items
    while width > 1:
        width = -(-width // node_size)
        ends.append(ends[-1] + width)
    return ends


# -- writing -------------------------------------------------------------------


def write_tree(
    boxes: np.ndarray, node_size: int = 16, single: bool = False, interleaved: bool = False, payloads: Sequence[bytes] | None = None,
    fixed_width: int = 0, prefix: int = 0, metadata: dict[str, str] | None = None, extra: Sequence[tuple[bytes, int, bytes]] = (),
) -> bytes:
    """A container of (n, 4 or 6) boxes; items are numbered by their rows."""
    boxes = np.asarray(boxes, np.float64)
    n, dims = len(boxes), boxes.shape[1] // 2
    if dims not in (2, 3) or np.isnan(boxes).any() or (boxes[:, :dims] > boxes[:, dims:]).any():
        raise ValueError("boxes need 4 or 6 bounds, none NaN and none crossed")
    node_size = min(max(node_size, 2), 65535)
    order = _curve_order(boxes, dims) if n > node_size else np.arange(n)
    level, links, all_boxes, all_links = boxes[order], order.astype(np.int64), [], []
    start = 0
    while n:
        all_boxes.append(level)
        all_links.append(links)
        if len(level) == 1 and len(all_boxes) > 1 or n == 1:
            break
        firsts = np.arange(0, len(level), node_size)
        low = np.minimum.reduceat(level[:, :dims], firsts)
        high = np.maximum.reduceat(level[:, dims:], firsts)
        links, start = firsts + start, start + len(level)
        level = np.hstack([low, high])
    nodes = np.vstack(all_boxes) if n else np.zeros((0, 2 * dims))
    index = np.concatenate(all_links).astype("<u8") if n else np.zeros(0, "<u8")
    if single:
        nodes = np.hstack([down(nodes[:, :dims]), up(nodes[:, dims:])]).astype("<f4")
    else:
        nodes = nodes.astype("<f8")
    width = nodes.itemsize
    tree = struct.pack("<IBBBxQH6x", 24, dims, width, int(interleaved), n, node_size)
    if interleaved:
        rows = np.hstack([np.ascontiguousarray(nodes).view(np.uint8).reshape(len(nodes), 2 * dims * width), index.view(np.uint8).reshape(len(nodes), 8)])
        tree += rows.tobytes()
    else:
        tree += nodes.tobytes() + index.tobytes()
    chunks = [(b"TREE", CRITICAL, tree)]
    if payloads is not None:
        if len(payloads) != n:
            raise ValueError("one payload for each item")
        ranked = [payloads[i] for i in order]
        if fixed_width:
            if any(len(p) != fixed_width for p in ranked):
                raise ValueError("every payload must have the fixed width")
            chunks.append((b"PYLD", 0, struct.pack("<IBBHI", 12, 0, 0, 0, fixed_width) + b"".join(ranked)))
        else:
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in ranked], dtype=np.int64))).astype("<u8")
            chunks.append((b"PYLD", 0, struct.pack("<IBBH", 8, 0, 0, 0) + offsets.tobytes() + b"".join(ranked)))
        if prefix:
            chunks.append((b"PFIX", 0, struct.pack("<IBBHI", 12, 0, 0, 0, prefix) + b"".join(p[:prefix].ljust(prefix, b"\0") for p in ranked)))
    if metadata:
        numbers = {name: k for k, name in META_FIELDS.items()}
        fields = [(numbers[k], v.encode()) for k, v in metadata.items()]
        chunks.append((b"META", 0, b"".join(struct.pack("<HI", k, len(v)) + v for k, v in sorted(fields))))
    return assemble([*chunks, *extra])


def assemble(chunks: Sequence[tuple[bytes, int, bytes]]) -> bytes:
    at = 32 + 24 * len(chunks)
    directory, body = b"", b""
    for tag, flags, content in chunks:
        pad = -(at + len(body)) % 8
        body += b"\0" * pad
        directory += struct.pack("<4sIQQ", tag, flags, at + len(body), len(content))
        body += content
    return MAGIC + struct.pack("<QI12x", VERSION, len(chunks)) + directory + body + b"\0" * (-(at + len(body)) % 8)


def append_chunk(data: bytes, tag: bytes, content: bytes, flags: int = 0) -> bytes:
    """The same file with one more application chunk."""
    if not tag[:1].islower():
        raise ValueError("application tags start with a lower-case letter")
    reader = BytesReader(data)
    return assemble([*[(t, f, reader.read(a, n)) for t, f, a, n in _directory(reader)], (tag, flags, content)])


def _curve_order(boxes: np.ndarray, dims: int) -> np.ndarray:
    centres = (boxes[:, :dims] + boxes[:, dims:]) / 2
    low, high = centres.min(axis=0), centres.max(axis=0)
    span = np.where(high > low, high - low, 1.0)
    with np.errstate(invalid="ignore"):
        cells = np.nan_to_num((centres - low) / span * 65535, nan=0, posinf=65535, neginf=0).clip(0, 65535).astype(np.int64)
    return np.argsort(hilbert_nd(cells, 16), kind="stable")


# -- reading -------------------------------------------------------------------


def _directory(reader: RangeReader) -> list[tuple[bytes, int, int, int]]:
    if reader.size() < 32:
        raise LoadError("too short")
    head = reader.read(0, 32)
    version, count = struct.unpack_from("<QI", head, 8)
    if head[:8] != MAGIC or version != VERSION:
        raise LoadError("wrong magic or version")
    if 32 + 24 * count > reader.size():
        raise LoadError("the directory is cut short")
    raw, found, end = reader.read(32, 24 * count), [], 32 + 24 * count
    for k in range(count):
        tag, flags, at, n = struct.unpack_from("<4sIQQ", raw, 24 * k)
        if at + n > reader.size() or at % 8:
            raise LoadError("a chunk lies outside the file")
        if flags & CRITICAL and tag not in KNOWN:
            raise LoadError("an unknown critical chunk")
        found.append((tag, flags, at, n))
        end = max(end, at + n)
    if reader.size() - end > 7:
        raise LoadError("bytes are left after the last chunk")
    return found


@dataclass
class Tree:
    """An opened container: shape and places, boxes only as they are asked for."""

    reader: RangeReader
    dims: int
    width: int
    interleaved: bool
    items: int
    node_size: int
    at: int
    ends: list[int]
    payload: tuple[int, int, int, int] | None
    prefix: tuple[int, int] | None
    metadata: dict[str, str]
    chunks: dict[bytes, tuple[int, int]]
    reads: int = 0
    bytes_read: int = 0
    limits: Limits = field(default_factory=Limits)

    @property
    def nodes(self) -> int:
        return self.ends[-1]

    @property
    def record(self) -> int:
        return 2 * self.dims * self.width

    def _read(self, at: int, n: int) -> bytes:
        self.reads += 1
        self.bytes_read += n
        if self.limits.max_reads is not None and self.reads > self.limits.max_reads:
            raise LimitExceeded("too many reads")
        if self.limits.max_bytes is not None and self.bytes_read > self.limits.max_bytes:
            raise LimitExceeded("too many bytes")
        return self.reader.read(at, n)

    def node_range(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Boxes (as doubles) and links of nodes low to high."""
        n, kind = high - low, f"<f{self.width}"
        if self.interleaved:
            stride = self.record + 8
            raw = np.frombuffer(self._read(self.at + low * stride, n * stride), np.uint8).reshape(n, stride)
            boxes = np.ascontiguousarray(raw[:, : self.record]).view(kind)
            links = np.ascontiguousarray(raw[:, self.record :]).view("<u8")[:, 0]
        else:
            boxes = np.frombuffer(self._read(self.at + low * self.record, n * self.record), kind).reshape(n, -1)
            links = np.frombuffer(self._read(self.at + self.nodes * self.record + 8 * low, 8 * n), "<u8")
        return boxes.astype(np.float64), links.astype(np.int64)

    def _runs(self, nodes: np.ndarray, unit: int) -> Iterator[tuple[int, int]]:
        """Node ranges that cover `nodes`, joined over small gaps."""
        cuts = np.flatnonzero(np.diff(nodes) > max(1, self.limits.gap_bytes // unit) + 1) + 1
        for part in np.split(nodes, cuts):
            if len(part):
                yield int(part[0]), int(part[-1]) + 1

    def search(self, window: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, leaf ranks) that meet a window; one with NaN meets nothing."""
        w = np.asarray(window, np.float64)
        if np.isnan(w).any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._descend(lambda b: (b[:, : self.dims] <= w[self.dims :]).all(axis=1) & (b[:, self.dims :] >= w[: self.dims]).all(axis=1))

    def search_region(self, region) -> tuple[np.ndarray, np.ndarray]:
        """(ids, leaf ranks) that meet a region which says its half-spaces. A node's box holds its children's, so it
        reaches at least as far."""
        cases = region.reaches(self.dims)

        def meets(boxes: np.ndarray) -> np.ndarray:
            low, high = boxes[:, : self.dims], boxes[:, self.dims :]
            far = lambda n, d: (np.where(n >= 0, high, low) * n).sum(axis=1) + d >= 0
            found = np.zeros(len(boxes), bool)
            for case in cases:
                found |= np.logical_and.reduce([far(np.asarray(n, float), d) for n, d in case])
            return found

        return self._descend(meets)

    def _descend(self, test) -> tuple[np.ndarray, np.ndarray]:
        """Level by level from the root; only the nodes in question are read."""
        if not self.items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        level, front = len(self.ends) - 1, np.array([self.nodes - 1])
        if level == 0:
            front = np.arange(self.items)
        while True:
            hit_nodes, hit_links = [], []
            for low, high in self._runs(front, self.record + 8):
                boxes, links = self.node_range(low, high)
                asked = np.isin(np.arange(low, high), front)
                keep = np.flatnonzero(asked & test(boxes))
                hit_nodes.append(keep + low)
                hit_links.append(links[keep])
            nodes, links = np.concatenate(hit_nodes), np.concatenate(hit_links)
            if level == 0:
                if ((links < 0) | (links >= self.items)).any():
                    raise LoadError("an item number is out of range")
                if self.limits.max_items is not None and len(nodes) > self.limits.max_items:
                    raise LimitExceeded("too many items")
                return links, nodes
            level -= 1
            start, end = (self.ends[level - 1] if level else 0), self.ends[level]
            if ((links < start) | (links >= end) | ((links - start) % self.node_size != 0)).any():
                raise LoadError("a link leads outside its level")
            front = np.unique(np.concatenate([np.arange(x, min(x + self.node_size, end)) for x in links])) if len(links) else np.zeros(0, np.int64)
            if not len(front):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def payload_at(self, ranks: Sequence[int]) -> list[bytes]:
        if self.payload is None:
            raise LoadError("the file has no payloads")
        at, n, stride, table = self.payload
        asked = np.asarray(ranks, np.int64)
        if len(asked) and not (0 <= asked.min() and asked.max() < self.items):
            raise IndexError("no such leaf")
        found: dict[int, bytes] = {}
        # Neighbouring leaves share a read of the table and one of the bodies.
        for low, high in self._runs(np.unique(asked), stride or max(16, self.limits.gap_bytes)):
            if stride:
                ends = np.arange(high - low + 1, dtype=np.int64) * stride + stride * low
            else:
                ends = np.frombuffer(self._read(table + 8 * low, 8 * (high - low + 1)), "<u8").astype(np.int64)
                if (np.diff(ends) < 0).any() or ends[0] < 0 or ends[-1] > n:
                    raise LoadError("a payload lies outside its chunk")
            first = int(ends[0])
            raw = self._read(at + first, int(ends[-1]) - first)
            for r, a, b in zip(range(low, high), ends[:-1].tolist(), ends[1:].tolist()):
                found[r] = raw[a - first : b - first]
        return [found[r] for r in asked.tolist()]

    def prefix_at(self, ranks: Sequence[int], length: int) -> list[bytes]:
        """The first bytes of payloads, from the prefix chunk where it has them."""
        if self.prefix and self.prefix[1] >= length:
            at, stride = self.prefix
            return [self._read(at + stride * r, stride)[:length] for r in ranks]
        return [p[:length] for p in self.payload_at(ranks)]

    def extent(self) -> tuple[float, ...] | None:
        return tuple(self.node_range(self.nodes - 1, self.nodes)[0][0].tolist()) if self.items else None

    def check(self) -> None:
        """Every link and the whole payload table."""
        for level, end in enumerate(self.ends if self.items else []):
            low = self.ends[level - 1] if level else 0
            _, links = self.node_range(low, end)
            if level == 0:
                good = (links >= 0) & (links < self.items)
            else:
                start = self.ends[level - 2] if level > 1 else 0
                good = (links >= start) & (links < low) & ((links - start) % self.node_size == 0)
            if not good.all():
                raise LoadError("a link leads outside its level")
        if self.payload and not self.payload[2]:
            at, n, _, table = self.payload
            offsets = np.frombuffer(self._read(table, 8 * (self.items + 1)), "<u8")
            if offsets[0] or (np.diff(offsets.astype(np.int64)) < 0).any() or offsets[-1] != n:
                raise LoadError("the payload table is broken")


def open_tree(reader: RangeReader, limits: Limits | None = None) -> Tree:
    directory = _directory(reader)
    chunks = {tag: (at, n) for tag, _, at, n in directory}
    if b"TREE" not in chunks:
        raise LoadError("there is no tree")
    at, n = chunks[b"TREE"]
    if n < 24:
        raise LoadError("the tree is cut short")
    size, dims, width, layout, items, node_size = struct.unpack("<IBBBxQH6x", reader.read(at, 24))
    if size < 24 or dims not in (2, 3) or width not in (4, 8) or layout > 1 or node_size < 2:
        raise LoadError("a bad tree descriptor")
    if items * (2 * dims * width + 8) > n:
        raise LoadError("the tree's length doesn't match its shape")
    ends = level_ends(items, node_size)
    if size + ends[-1] * (2 * dims * width + 8) != n:
        raise LoadError("the tree's length doesn't match its shape")
    payload = prefix = None
    if b"PYLD" in chunks:
        p, length = chunks[b"PYLD"]
        head = struct.unpack("<IBBH", reader.read(p, 8))
        stride = struct.unpack("<I", reader.read(p + 8, 4))[0] if head[0] >= 12 else 0
        table = 0 if stride else 8 * (items + 1)
        body = length - head[0] - table
        if head[0] < 8 or head[1] or head[2] or body < 0 or stride and body != stride * items:
            raise LoadError("a bad payload chunk")
        payload = (p + head[0] + table, body, stride, p + head[0])
    if b"PFIX" in chunks:
        p, length = chunks[b"PFIX"]
        size_p, _, _, _, stride = struct.unpack("<IBBHI", reader.read(p, 12))
        if size_p < 12 or not stride or length != size_p + stride * items:
            raise LoadError("a bad prefix chunk")
        prefix = (p + size_p, stride)
    return Tree(reader, dims, width, bool(layout), items, node_size, at + size, ends, payload, prefix, _metadata(reader, chunks), chunks, limits=limits or Limits())


def _metadata(reader: RangeReader, chunks: dict[bytes, tuple[int, int]]) -> dict[str, str]:
    at, n = chunks.get(b"META", (0, 0))
    raw, p, found = reader.read(at, n) if n else b"", 0, {}
    while p + 6 <= len(raw):
        key, size = struct.unpack_from("<HI", raw, p)
        if p + 6 + size > len(raw):
            raise LoadError("a metadata field is cut short")
        if key in META_FIELDS:
            found[META_FIELDS[key]] = raw[p + 6 : p + 6 + size].decode()
        p += 6 + size
    return found


# -- Spark ---------------------------------------------------------------------

#: Leaves in a partition of the data source.
PARTITION_LEAVES = 1 << 16


@dataclass
class LeafRun(InputPartition):
    low: int
    high: int


class BoxTreeReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.dims, self.window = path, sum(f.name.startswith("min_") for f in schema.fields), {}

    def pushFilters(self, filters):  # noqa: N802
        """Comparisons of bounds are kept for pruning and left to Spark to apply."""
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            kind = type(f).__name__
            if name and isinstance(value, (int, float)) and (name.startswith("min_") and kind.startswith("LessThan") or name.startswith("max_") and kind.startswith("GreaterThan")):
                self.window[name] = value
            yield f

    def partitions(self):
        tree = open_tree(FileReader(self.path))
        runs = [LeafRun(low, min(low + PARTITION_LEAVES, tree.items)) for low in range(0, tree.items, PARTITION_LEAVES)]
        if len(self.window) < 2 * self.dims or not runs:
            return runs or [LeafRun(0, 0)]
        high = [float(self.window[n]) for n in box_names(self.dims)[: self.dims]]
        low = [float(self.window[n]) for n in box_names(self.dims)[self.dims :]]
        _, ranks = tree.search([*low, *high])
        hit = set((ranks // PARTITION_LEAVES).tolist())
        return [r for r in runs if r.low // PARTITION_LEAVES in hit] or [LeafRun(0, 0)]

    def read(self, partition):
        if partition.high <= partition.low:
            return
        tree = open_tree(FileReader(self.path))
        boxes, links = tree.node_range(partition.low, partition.high)
        ranks = range(partition.low, partition.high)
        blobs = tree.payload_at(ranks) if tree.payload else [None] * len(links)
        for i, b, p in zip(links.tolist(), boxes.tolist(), blobs):
            yield (i, *b, p)


class BoxTreeSource(DataSource):
    """Options: path. Columns: item_id, bounds, payload."""

    @classmethod
    def name(cls) -> str:
        return "boxtree"

    def schema(self) -> str:
        tree = open_tree(FileReader(self.options["path"]))
        return f"item_id long, {', '.join(f'{n} double' for n in box_names(tree.dims))}, payload binary"

    def reader(self, schema) -> BoxTreeReader:
        return BoxTreeReader(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Also lets Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BoxTreeSource)


def pack_containers(df, dims: int = 2, item_id: str = "item_id", node_size: int = 16, rows_each: int = 1 << 20):
    """Containers of a clustered frame, a few for each partition: (part, items,
    bounds, container). Item ids are fixed-width payloads of 8 bytes."""
    import pandas as pd

    names = box_names(dims)

    def pack(frames):
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId(), [], 0

        def flush():
            rows = pd.concat(held)
            boxes = rows[names].to_numpy(np.float64)
            blobs = [struct.pack("<q", i) for i in rows[item_id]]
            data = write_tree(boxes, node_size, payloads=blobs, fixed_width=8)
            bounds = [*boxes[:, :dims].min(axis=0), *boxes[:, dims:].max(axis=0)]
            return pd.DataFrame([(part, len(rows), *bounds, data)], columns=["part", "items", *names, "container"])

        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= rows_each:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    schema = f"part int, items long, {', '.join(f'{n} double' for n in names)}, container binary"
    return df.select(item_id, *names).mapInPandas(pack, schema)


def search_containers(containers, where):
    """item_id of every match of a window or region: containers whose bounds miss
    it are pruned by the scan, the others are descended from their roots."""
    import pandas as pd

    from tessera.functions.boxes import box, box_columns, overlaps

    region = where if hasattr(where, "reaches") else None
    dims = 3 if "min_z" in containers.columns else 2

    def search(frames):
        for frame in frames:
            for data in frame["container"]:
                tree = open_tree(BytesReader(bytes(data)))
                _, ranks = tree.search([float(v) for v in where]) if region is None else tree.search_region(region)
                ids = [struct.unpack("<q", p)[0] for p in tree.payload_at(ranks.tolist())]
                yield pd.DataFrame({"item_id": np.array(ids, np.int64)})

    own = box_columns(dims)
    near = containers.filter(overlaps(own, box(*where)) if region is None else region.overlaps_box(own))
    return near.select("container").mapInPandas(search, "item_id long")
