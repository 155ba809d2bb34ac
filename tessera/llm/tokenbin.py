"""Token ids in patched frame-of-reference blocks.

Ids are cut into blocks of 128. A block stores its minimum, a bit width that a
percentile of its ids fits (after the minimum is taken off), the ids packed at
that width, and the few that don't fit as exceptions: positions and full
values. An index holds where each block starts, so any block is read alone.

A dataset is a Parquet table of segments, written through Spark's committed
writers to any store: (part, seq, n_ids, n_docs, payload). Parts are ranges of
doc_id in ascending order, segments are in order within a part, and each
holds whole documents and their own index. A segment's payload:

    8 bytes magic | u32 ids | u32 docs | u32 blocks | u32 end of the id stream
    u32 for each block: where it starts in the id stream
    for each block: u32 minimum | u8 width | u8 exceptions |
                    16 * width bytes packed | u8 positions | u32 values
    i64 doc ids | u8 doc-id-is-null flags | u32 ids of each document

Ids are below 2**32. Defined cases: a null or empty text is just its end id; a
null doc_id sorts first; rows of one doc_id are in order of their texts' hashes,
then of their texts, so that the file depends on the rows alone; repeated rows
are stored once for each row; an empty table gives an empty dataset; other
columns are not stored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fresh_folder
from .tokens import encoder, tokenizer_path

MAGIC = b"PFORIDS1"
SIZE = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 18
PART_BYTES = 64 << 20
#: Plans of unknown size say more than this.
UNKNOWN_BYTES = 1 << 52
SEGMENTS = "part int, seq int, n_ids long, n_docs long, payload binary"


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(n, 128) values below 2**width as (n, 16 * width) bytes."""
    out = np.zeros((2 * width, len(rows)), np.uint64)
    for k, column in enumerate(np.ascontiguousarray(rows.T)):
        word, shift = divmod(k * width, 64)
        out[word] |= column << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).view(np.uint8)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view(np.uint64).T)
    out = np.zeros((SIZE, packed.shape[0]), np.uint64)
    for k in range(SIZE):
        word, shift = divmod(k * width, 64)
        out[k] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[k] |= words[word + 1] << np.uint64(64 - shift)
    return np.ascontiguousarray((out & np.uint64((1 << width) - 1)).T)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_ids(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The id stream: block starts, then blocks."""
    n = -(-len(ids) // SIZE)
    if not n:
        return b""
    padded = np.full(n * SIZE, ids[-1], np.uint64)
    padded[: len(ids)] = ids
    rows = padded.reshape(n, SIZE)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    at = min(SIZE - 1, int(np.ceil(percentile * SIZE)) - 1)
    width = _bits(np.partition(rows, at, axis=1)[:, at])
    out = rows >> width.astype(np.uint64)[:, None] > 0
    n_out = out.sum(axis=1)
    sizes = 6 + 16 * width + 5 * n_out
    starts = np.concatenate(([0], np.cumsum(sizes)))
    stream = np.zeros(starts[-1], np.uint8)
    head = np.zeros((n, 6), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4], head[:, 5] = width, n_out
    stream[starts[:-1, None] + np.arange(6)] = head
    plain = np.where(out, np.uint64(0), rows)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            stream[starts[own][:, None] + 6 + np.arange(16 * w)] = _pack(plain[own], int(w))
    block, position = np.nonzero(out)
    if len(block):
        rank = np.arange(len(block)) - np.concatenate(([0], np.cumsum(n_out)))[block]
        base = starts[block] + 6 + 16 * width[block]
        stream[base + rank] = position
        values = rows[block, position].astype("<u4").view(np.uint8).reshape(-1, 4)
        stream[(base + n_out[block] + 4 * rank)[:, None] + np.arange(4)] = values
    return starts[:-1].astype("<u4").tobytes() + stream.tobytes()


def decode_blocks(stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start there, 128 a row."""
    rows = np.zeros((len(starts), SIZE), np.uint64)
    head = stream[starts[:, None] + np.arange(6)]
    width, n_out = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            rows[own] = _unpack(stream[starts[own][:, None] + 6 + np.arange(16 * w)], int(w))
    block = np.repeat(np.arange(len(starts)), n_out)
    if len(block):
        rank = np.arange(len(block)) - np.concatenate(([0], np.cumsum(n_out)))[block]
        base = starts[block] + 6 + 16 * width[block]
        values = np.ascontiguousarray(stream[(base + n_out[block] + 4 * rank)[:, None] + np.arange(4)])
        rows[block, stream[base + rank]] = values.view("<u4")[:, 0]
    return rows + np.ascontiguousarray(head[:, :4]).view("<u4").astype(np.uint64)


def encode_segment(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    stream = encode_ids(ids, percentile)
    n = -(-len(ids) // SIZE)
    head = np.array([len(ids), len(doc_ids), n, len(stream) - 4 * n], "<u4").tobytes()
    missing = np.array([x is None for x in doc_ids], np.uint8)
    known = np.array([0 if x is None else x for x in doc_ids], "<i8")
    return MAGIC + head + stream + known.tobytes() + missing.tobytes() + lengths.astype("<u4").tobytes()


def decode_segment(payload: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """(ids as little-endian u32, doc ids, ids of each document)."""
    if payload[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    n_ids, n_docs, n, size = np.frombuffer(payload, "<u4", 4, 8).astype(np.int64)
    starts = np.frombuffer(payload, "<u4", n, 24).astype(np.int64)
    at = 24 + 4 * n
    ids = decode_blocks(np.frombuffer(payload, np.uint8, size, at), starts).ravel()[:n_ids].astype("<u4")
    at += size
    known = np.frombuffer(payload, "<i8", n_docs, at).tolist()
    missing = np.frombuffer(payload, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(payload, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    return ids, [None if m else k for k, m in zip(known, missing)], lengths


def _parts(docs: DataFrame) -> int:
    """Ranges of about PART_BYTES by the plan's estimate, no fewer than the session's shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= UNKNOWN_BYTES else max(least, -(-size // PART_BYTES))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None) -> None:
    """Encode every text and write the dataset at `path`, documents in
    ascending doc_id order. Texts are shuffled once, by ranges of (doc_id, hash
    of the text, place in `docs`), so that many rows of one id, or without one,
    fall in several ranges; equal rows alone are told apart by their place."""
    parts = parts or _parts(docs)
    end = np.array([end_id], "<u4")

    def segments(batches):
        from pyspark import TaskContext

        part, seq, held, size, names = TaskContext.get().partitionId(), 0, [], 0, []

        def flush():
            lengths = np.array([len(x) for x in held], np.int64)
            payload = encode_segment(np.concatenate(held), names, lengths)
            columns = [[part], [seq], [int(lengths.sum())], [len(held)], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "seq", "n_ids", "n_docs", "payload"]
            )

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j, ids, bounds in encoder(tokenizer).blocks(batch.column("text")):
                for k in range(i, j):
                    held.append(np.append(ids[bounds[k - i] : bounds[k - i + 1]], end))
                    names.append(doc_ids[k])
                    size += len(held[-1])
                    if size >= SEGMENT_IDS:
                        yield flush()
                        seq, held, size, names = seq + 1, [], 0, []
        if held:
            yield flush()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row for each stored document: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32, and the ids as little-endian u32 bytes.

    Starts come from running sums over segments within a part and over parts,
    both far smaller than the documents.
    """

    def decode(batches):
        for batch in batches:
            for part, seq, payload in zip(*[batch.column(c) for c in ("part", "seq", "payload")]):
                ids, names, lengths = decode_segment(payload.as_py())
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                pieces = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = {
                    "part": pa.array(np.full(len(names), part.as_py(), np.int32)),
                    "seq": pa.array(np.full(len(names), seq.as_py(), np.int32)),
                    "doc_id": pa.array(names, pa.int64()),
                    "local": pa.array(ends - lengths),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(pieces, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    stored = read_segments(spark, path)
    sums = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = sums.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part")
    )
    in_part = Window.partitionBy("part").orderBy("seq")
    bases = (
        stored.select("part", "seq", (F.sum("n_ids").over(in_part) - F.col("n_ids")).alias("before"))
        .join(before_part, "part")
        .select("part", "seq", (F.col("before") + F.col("before_part")).alias("base"))
    )
    found = stored.select("part", "seq", "payload").mapInArrow(decode, schema).join(bases, ["part", "seq"])
    return found.select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def op4_token_ids(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_folder(spark, "tokens")
    write_tokens(docs, path, tokenizer_path("byte_bpe_50k.json"))
    return read_tokens(spark, path, with_ids=False)
