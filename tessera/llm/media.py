"""Media columns: signature sniffing, type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over
a byte string; for each hit a validator of the format follows its structure
(chunks, blocks, checksums, sizes) and says where the medium ends, or that
there is none. The medium that starts at byte 0 corrects the declared type;
validated media further in are carved out with their place and length. Bytes
that a medium has taken belong to no other, so what is carved is never more
than what was given.

`store_payloads` keeps byte strings losslessly as 8-bit mono PCM in WAV files,
a table column like any other, and `read_media` takes them back through the
sniffer: what it returns comes from the stored bytes only.

Defined cases: null or empty bytes have no type and nothing to carve; a null
text is the empty payload, which is padded to one unit; a medium cut short or
with a wrong checksum isn't one; repeated rows give equal rows; an empty table
gives an empty table; other columns aren't kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_folder

UNIT = 64
RATE = 8000

# The first bytes of public media formats.
MAGIC = {
    b"RIFF": "wav",
    b"\x89PNG\r\n\x1a\n": "png",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"\xff\xd8\xff": "jpeg",
    b"BM": "bmp",
    b"P5": "pgm",
    b"fLaC": "flac",
    b"OggS": "ogg",
    b"\x1f\x8b\x08": "gzip",
    b"%PDF-": "pdf",
}
TYPES = {
    "wav": "audio/wav", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "pgm": "image/x-portable-graymap",
    "flac": "audio/flac", "ogg": "audio/ogg", "gzip": "application/gzip", "pdf": "application/pdf",
}


def wav_bytes(samples: bytes) -> bytes:
    """8-bit unsigned mono PCM; an odd number of samples is padded outside the data size."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def _wav_chunks(data: bytes, at: int):
    """(end, place and size of the data chunk, bits a sample), or None."""
    if len(data) - at < 12 or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    p, bits, found = at + 12, None, None
    while p + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, p)
        if p + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            kind, channels, rate, per_second, frame, bits = struct.unpack_from("<HHIIHH", data, p + 8)
            if not channels or frame * 8 != channels * bits or per_second != rate * frame:
                return None
        if name == b"data":
            found = (p + 8, size)
        p += 8 + size + size % 2
    return (end, *found, bits) if found and bits and p == end else None


def _wav(data: bytes, at: int) -> int | None:
    found = _wav_chunks(data, at)
    return found[0] if found else None


def _png(data: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, p)
        stop = p + 12 + size
        if stop > len(data) or first and (name, size) != (b"IHDR", 13):
            return None
        if zlib.crc32(data[p + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            return None
        if name == b"IEND":
            return stop
        p, first = stop, False
    return None


def _gif(data: bytes, at: int) -> int | None:
    if len(data) < at + 13:
        return None
    flags = data[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(p: int) -> int | None:
        while p < len(data):
            if not data[p]:
                return p + 1
            p += 1 + data[p]
        return None

    while p is not None and p < len(data):
        if data[p] == 0x3B:
            return p + 1
        if data[p] == 0x21:
            p = blocks(p + 2)
        elif data[p] == 0x2C and p + 10 <= len(data):
            flags = data[p + 9]
            p = blocks(p + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(data: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(data) and data[p] == 0xFF:
        mark = data[p + 1]
        if mark == 0xD9:
            return p + 2
        size = struct.unpack_from(">H", data, p + 2)[0]
        if size < 2:
            return None
        p += 2 + size
        if mark == 0xDA:  # coded data: up to a marker that isn't stuffing or a restart
            while True:
                p = data.find(b"\xff", p)
                if p < 0 or p + 1 >= len(data):
                    return None
                if data[p + 1] and not 0xD0 <= data[p + 1] <= 0xD7:
                    break
                p += 2
            if data[p + 1] == 0xD9:
                return p + 2
    return None


def _bmp(data: bytes, at: int) -> int | None:
    if len(data) < at + 54:
        return None
    size, reserved, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    good = not reserved and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0
    return at + size if good and 14 + head <= start and start + rows <= size and at + size <= len(data) else None


def _pgm(data: bytes, at: int) -> int | None:
    parts, p = [], at + 2
    while len(parts) < 3:
        if p >= len(data) or data[p] not in b" \t\r\n":
            return None
        while p < len(data) and data[p] in b" \t\r\n":
            p += 1
        start = p
        while p < len(data) and 48 <= data[p] <= 57 and p - start < 10:
            p += 1
        if p == start:
            return None
        parts.append(int(data[start:p]))
    width, height, most = parts
    end = p + 1 + width * height * (1 if most < 256 else 2)
    return end if p < len(data) and data[p] in b" \t\r\n" and width * height and 0 < most < 65536 and end <= len(data) else None


def _flac(data: bytes, at: int) -> int | None:
    p = at + 4
    if len(data) < p + 38 or data[p] & 0x7F or int.from_bytes(data[p + 1 : p + 4]) != 34:
        return None
    while p + 4 <= len(data):
        last, p = data[p] & 0x80, p + 4 + int.from_bytes(data[p + 1 : p + 4])
        if last:  # frames carry no total length: the stream runs to the end
            return len(data) if p + 2 <= len(data) and data[p] == 0xFF and data[p + 1] >> 2 == 0x3E else None
    return None


_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def _ogg_checksum(page: bytes) -> int:
    """CRC-32 of the page with a blank checksum field, bits not mirrored, no inversions."""
    mirrored = zlib.crc32((page[:22] + b"\0\0\0\0" + page[26:]).translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _ogg(data: bytes, at: int) -> int | None:
    """All pages of a stream from one that continues no packet to the last; a
    checksum of 0 is taken for one that was left out."""
    p, stream = at, data[at + 14 : at + 18]
    if len(data) < at + 27 or data[at + 5] & 1:
        return None
    while p + 27 <= len(data) and data[p : p + 5] == b"OggS\0" and data[p + 14 : p + 18] == stream:
        n = data[p + 26]
        stop = p + 27 + n + sum(data[p + 27 : p + 27 + n])
        given = int.from_bytes(data[p + 22 : p + 26], "little")
        if stop > len(data) or given and given != _ogg_checksum(data[p:stop]):
            return None
        if data[p + 5] & 4:
            return stop
        p = stop
    return None


def _gzip(data: bytes, at: int) -> int | None:
    unpack = zlib.decompressobj(31)
    try:
        view = memoryview(data)[at:]
        unpack.decompress(view, 1 << 20)
        while not unpack.eof and unpack.unconsumed_tail:
            unpack.decompress(unpack.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return len(data) - len(unpack.unused_data) if unpack.eof else None


def _pdf(data: bytes, at: int) -> int | None:
    last = data.rfind(b"%%EOF", at)
    return last + 5 if last > 0 and data.rfind(b"startxref", at, last) > 0 else None


#: Kinds whose contents are bytes of any kind.
CONTAINERS = frozenset({"wav", "pdf"})
VALIDATORS = {"wav": _wav, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pgm": _pgm, "flac": _flac, "ogg": _ogg, "gzip": _gzip, "pdf": _pdf}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(data: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, start, length) of every validated medium in order. What lies in
    one isn't looked at again, but for a container that starts at byte 0: its
    contents are searched like loose bytes. So embedded media don't overlap."""
    found, free, closed = [], 0, set()
    for last, (size, kind) in _automaton().iter((data or b"").decode("latin-1")):
        start = last - size + 1
        if start < free or kind in closed:
            continue
        end = VALIDATORS[kind](data, start)
        if end is not None:
            found.append((kind, start, end - start))
            if start or kind not in CONTAINERS:
                free = end
        if kind == "pdf":  # another one that starts later ends where this one does, or not at all
            closed.add(kind)
    return found


def correct_types(media: DataFrame, column: str = "media", declared: str = "declared") -> DataFrame:
    """`media` with sniffed (null if nothing valid starts at byte 0), type (the
    sniffed, else the declared one) and carved: embedded media as an array of
    (type, start, bytes)."""
    names = [c for c in media.columns if c not in ("sniffed", "type", "carved")]
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("bytes", pa.binary())]))

    def correct(batches):
        for batch in batches:
            sniffed, types, carved = [], [], []
            for x, said in zip(batch.column(column), batch.column(declared).to_pylist()):
                data = x.as_py()
                found = sniff(data)
                own = next((TYPES[k] for k, s, _ in found if s == 0), None)
                sniffed.append(own)
                types.append(own or said)
                carved.append([{"type": TYPES[k], "start": s, "bytes": data[s : s + n]} for k, s, n in found if s])
            columns = [batch.column(c) for c in names] + [pa.array(sniffed, pa.string()), pa.array(types, pa.string()), pa.array(carved, kind)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sniffed", "type", "carved"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*names).schema)
    added = "sniffed string, type string, carved array<struct<type: string, start: long, bytes: binary>>"
    return media.select(*names).mapInArrow(correct, f"{fields}, {added}")


def store_payloads(docs: DataFrame, path: str) -> None:
    """Texts as WAV media in a table at `path`: doc_id, n_bytes, declared, media."""

    def store(batches):
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column("text")]
            media = [wav_bytes(t + b"\0" * ((-len(t) % UNIT) if t else UNIT)) for t in texts]
            columns = [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")
    rows.withColumn("declared", F.lit("application/octet-stream")).write.option("compression", "zstd").parquet(path)


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def read_media(media: DataFrame) -> DataFrame:
    """Features of stored payloads, from the stored bytes: the sniffer finds the
    container, its validator the samples."""

    def read(batches):
        for batch in batches:
            rows = []
            for doc_id, n, declared, x in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "declared", "media")]):
                found = sniff(x)
                if not found or found[0][:2] != ("wav", 0):
                    raise ValueError(f"the stored medium of document {doc_id} is damaged")
                _, at, size, _ = _wav_chunks(x, 0)
                payload = x[at : at + size]
                samples = np.frombuffer(payload, np.uint8)
                count = np.bincount(samples, minlength=256)
                total, squares = int(count @ np.arange(256)), int(count @ np.arange(256) ** 2)
                mean = total / size
                feature = (
                    f"{declared}>{TYPES['wav']} embedded={len(found) - 1} mean={mean:.4f} "
                    f"deviation={max(squares / size - mean * mean, 0) ** 0.5:.4f} high={int(count[128:].sum())} levels={int((count > 0).sum())}"
                )
                rows.append(
                    (doc_id, n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(x), hashlib.sha256(x).hexdigest(), feature)
                )
            names = [f.split()[0] for f in FEATURES.split(", ")]
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(read, FEATURES)


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "media")
    store_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_media(spark.read.parquet(path))
