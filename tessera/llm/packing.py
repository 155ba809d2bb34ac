"""Packing documents into sequences with minimum bin slack.

Documents are cut into full sequences of `capacity` ids and one shorter rest.
Rests are packed by their lengths alone: a sequence takes the longest rest
left, and a subset-sum table over the multiset of the other lengths, kept as
the bits of one integer, finds the filling closest to capacity; walking back
through the table gives how many rests of each length it takes. The filling is
repeated as often as the counts allow, so the plan depends on the histogram of
lengths (at most `capacity` numbers, all that reaches the driver) and not on
the number of documents.

The plan says which ranks of a length go where. Ranks are dealt out over
buckets of a hash of the piece's number in the stored table: counts of (length,
bucket) give each bucket's first rank, and rows are numbered within a bucket, so
a length that a third of all rows share is spread over all buckets, repeated
rows and rows without id too.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed once for each row; rows without id are packed too; an empty table gives
no sequence. Other columns are not kept.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise
from .tokens import encoder, tokenizer_path
from .workers import tidy

CAPACITY = 4096
BUCKET_ROWS = 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, __piece long"


def fullest_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths, and how many of each, that fill a window closest to capacity
    with the longest length in it."""
    longest = max(counts)
    room = capacity - longest
    everything = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        free, share = min(counts[length] - (length == longest), room // length), 1
        while free > 0 and not reach >> room & 1:
            n = min(share, free)
            steps.append((length, n, reach))
            reach |= reach << (n * length) & everything
            free, share = free - n, share * 2
        if reach >> room & 1:
            break
    left, taken = reach.bit_length() - 1, Counter({longest: 1})
    for length, n, before in reversed(steps):
        if not before >> left & 1:
            taken[length] += n
            left -= n * length
    return dict(taken)


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number in each window, first window, offset) for
    each length of each filling; a filling of n windows takes n times its
    number of the next ranks of every length in it."""
    left = {k: v for k, v in histogram.items() if v}
    used, plan, window = Counter(), [], 0
    while left:
        filling = fullest_window(left, capacity)
        times = min(left[k] // m for k, m in filling.items())
        offset = 0
        for k, m in sorted(filling.items(), reverse=True):
            plan.append((k, used[k], m, window, offset))
            used[k] += times * m
            left[k] -= times * m
            offset += k * m
            if not left[k]:
                del left[k]
        window += times
    return plan


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids: full ones, and the rest of each
    document. `__piece` numbers them within their task, which is stable once
    they are stored, and tells repeated rows apart."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, raw, doc_ids = [], [], batch.column("doc_id").to_pylist()
            for i, j, ids, bounds in encoder(tokenizer).blocks(batch.column("text")):
                whole = ids.tobytes()
                for k in range(i, j):
                    own = whole[4 * bounds[k - i] : 4 * bounds[k - i + 1]] + end
                    total = len(own) // 4
                    for start in range(0, total, capacity):
                        piece = own[4 * start : 4 * (start + capacity)]
                        rows.append((doc_ids[k], start, len(piece) // 4, zlib.crc32(piece), total, number))
                        number += 1
                        if with_ids:
                            raw.append(piece)
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "__piece"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(cut), PIECES + ", ids binary" * with_ids)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (a stored table with length and __piece) with sequence_id and
    offset, and without __piece."""
    counts = pieces.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}  # at most `capacity` rows
    if max(histogram, default=0) > capacity:
        raise ValueError("a piece is longer than a sequence")
    plan = sorted(packing_plan(histogram, capacity))
    length, rank, number, window, offset = np.array(plan, np.int64).reshape(-1, 5).T
    span = max(1, int(rank.max(initial=0)) + 1, sum(histogram.values()) + 1)
    if span * (capacity + 1) >= 1 << 63:
        raise ValueError("too many pieces for one plan")
    table = pieces.sparkSession.sparkContext.broadcast((length * span + rank, rank, number, window, offset))

    def place(batches):
        keys, rank, number, window, offset = table.value
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            row = np.searchsorted(keys, n * span + r, "right") - 1
            turn, slot = np.divmod(r - rank[row], number[row])
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__rank"]
            names = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(window[row] + turn), pa.array(offset[row] + slot * n)], [*names, "sequence_id", "offset"]
            )

    buckets = max(8, -(-sum(histogram.values()) // BUCKET_ROWS))
    bucketed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("__piece"), F.lit(buckets)))
    sums = bucketed.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    firsts = sums.select(
        "length", "__bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("n")).alias("__first")
    )
    order = Window.partitionBy("length", "__bucket").orderBy("__piece")
    numbered = bucketed.withColumn("__row", F.row_number().over(order)).join(firsts, ["length", "__bucket"])
    kept = [c for c in pieces.columns if c != "__piece"]
    ranked = numbered.select(*kept, (F.col("__first") + F.col("__row") - 1).cast("long").alias("__rank"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept)
    return ranked.mapInArrow(tidy(place), f"{names}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row for each piece: where it comes from and where it goes;
    `with_ids` adds its ids as little-endian u32 bytes."""
    return place_pieces(materialise(cut_documents(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)


def op7_pack_sequences(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
