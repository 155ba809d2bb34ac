"""Quality rules: text statistics and a hashed n-gram likelihood ratio.

A multinomial over hashed byte n-grams is fitted to trusted texts, another to
the distinct texts of the whole corpus. A document's score is the sum of
log(p_trusted / p_corpus) over its n-grams divided by their number, and it is
kept if the score reaches a fixed threshold: no sampling, every document is
judged and every rerun agrees.

How often clean text occurs doesn't matter: exact copies count once in both
multinomials, and each language has the weight in the corpus multinomial that
it has in the trusted one, so that a language which the labels cover little
isn't taken for bad. Where `docs` has no column lang, all are one language; one
without any trusted text has no weight.

What is bounded: at most `trusted_rows` labelled rows (smallest hashes of
their ids) name the trusted texts, and the model is one number for each of
`2**BUCKET_BITS` buckets, which is all that reaches the driver. Corpus counts
come from every distinct text; copies are joined within tasks before they move,
and only texts that have copies move. A task sends one row a language and
bucket each time that it holds LANGUAGES of them, so no key is hot.

Defined cases: a null or empty text has no words and fails the base rules; a
text shorter than an n-gram scores 0; without any trusted text every score is
0 and the base rules decide alone; repeated rows are judged alike; an empty
table gives an empty table. Clashing input columns named like the results are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise
from .textblocks import Block, exact_runs, repeated, text_blocks
from .workers import tidy

BUCKET_BITS = 16
NGRAM_BYTES = 4
TRUSTED_ROWS = 20_000
#: Nats an n-gram. Running text scores -0.1 to 0.1, tables of fragments, symbol
#: noise and shouted text mostly below -1.
THRESHOLD = -0.2
PRIOR = 1.0
#: Languages that a task counts side by side.
LANGUAGES = 16
#: Digests of copied texts are broadcast up to this number.
BROADCAST_ROWS = 200_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*COUNTS, "base_failed", "score", "kept")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """Exact counts: words and lines are compared as strings, not by hashes."""
    of = block.of_word()
    first, key = exact_runs(block.words()[1], of, 3)
    again = first[repeated(key)]
    covered = np.zeros(len(of), bool)
    for k in range(3):
        covered[again + k] = True
    return {
        "n_words": block.n_words,
        "word_chars": block.count(block.solid & ((block.data & 0xC0) != 0x80)),
        "n_symbols": block.count(_SYMBOL[block.data]),
        "n_dup_lines": _duplicate_lines(block),
        "n_repeat_words": np.bincount(of[covered], minlength=block.n),
    }


def _duplicate_lines(block: Block) -> np.ndarray:
    starts, ends, of = block.lines()
    worded = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends, of = starts[worded], ends[worded], of[worded]
    lines = block.line_ids(starts, ends)
    keys = of * (len(lines) + 1) + lines
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    return np.bincount(of[order[1:][same]], minlength=block.n)


def ngram_buckets(block: Block, n: int = NGRAM_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram that lies within one text, and each text's bounds."""
    runs = np.maximum(np.diff(block.offsets) - n + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(runs)))
    if not bounds[-1]:
        return np.zeros(0, np.int64), bounds
    total = len(block.data) - n + 1
    h = block.data[:total].astype(np.uint64)
    for k in range(1, n):
        h = (h << np.uint64(8)) | block.data[k : k + total]
    with np.errstate(over="ignore"):
        buckets = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    if bounds[-1] < total:
        buckets = buckets[np.repeat(block.offsets[:-1] - bounds[:-1], runs) + np.arange(bounds[-1])]
    return buckets, bounds


def distinct_texts(docs: DataFrame, trusted: frozenset) -> DataFrame:
    """(lang, text, good) of every distinct text; it is good if a row of it is
    trusted. Texts without copies stay where they are."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    digest = [F.xxhash64("text").alias("__h1"), F.xxhash64(F.lit("second"), "text").alias("__h2")]
    rows = docs.select("doc_id", lang.alias("lang"), "text", *digest)
    named = spark.createDataFrame([(x,) for x in sorted(trusted)], T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]))
    named = F.broadcast(named.withColumn("good", F.lit(True)))
    rows = rows.join(named, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    copied = docs.select(*digest).groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copied = materialise(copied, "copied")
    if copied.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        copied = F.broadcast(copied)
    once = rows.join(copied, ["__h1", "__h2"], "left_anti")
    more = rows.join(copied, ["__h1", "__h2"], "left_semi").groupBy("__h1", "__h2")
    more = more.agg(F.min("lang").alias("lang"), F.first("text").alias("text"), F.max("good").alias("good"))
    return once.select("lang", "text", "good").union(more.select("lang", "text", "good"))


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(lang, bucket, raw, trusted) over all rows of (lang, text, good), and
    over the good ones."""

    def rows_of(held):
        for lang, (raw, aim) in held.items():
            seen = np.flatnonzero(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(raw[seen]), pa.array(aim[seen])],
                ["lang", "bucket", "raw", "trusted"],
            )
        held.clear()

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            good = batch.column("good").to_numpy(zero_copy_only=False)
            for i, j, block in text_blocks(batch.column("text")):
                buckets, bounds = ngram_buckets(block)
                names, code = np.unique(langs[i:j], return_inverse=True)
                code, mine = np.repeat(code, np.diff(bounds)), np.repeat(good[i:j], np.diff(bounds))
                for k, lang in enumerate(names.tolist()):
                    if lang not in held:
                        if len(held) == LANGUAGES:
                            yield from rows_of(held)
                        held[lang] = tuple(np.zeros((2, 1 << BUCKET_BITS), np.int64))
                    raw, aim = held[lang]
                    own = code == k
                    raw += np.bincount(buckets[own], minlength=1 << BUCKET_BITS)
                    own &= mine
                    if own.any():
                        aim += np.bincount(buckets[own], minlength=1 << BUCKET_BITS)
        yield from rows_of(held)

    rows = texts.mapInArrow(tidy(count), "lang string, bucket long, raw long, trusted long")
    return rows.groupBy("lang", "bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> frozenset:
    """Ids of labelled good, clean rows: at most `rows`, those of the smallest
    hashes, whatever order the table has."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    picked = good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return frozenset(r[0] for r in picked.collect())


def log_ratios(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> np.ndarray:
    """log(p_trusted / p_corpus) of each bucket, 0 where nothing is trusted.

    A language's corpus counts are scaled to the size of its trusted ones.
    Both multinomials are smoothed by the same share of their size, so a
    bucket seen as often as expected has ratio 0 however small the trusted
    part is."""
    expected, aim = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    trusted = trusted_ids(labels, trusted_rows)
    if not trusted:
        return np.zeros(len(aim), np.float32)
    counts = materialise(ngram_counts(distinct_texts(docs, trusted)), "ngrams")
    shares = counts.groupBy("lang").agg((F.sum("trusted") / F.sum("raw")).alias("share")).filter("share > 0")
    scaled = counts.join(F.broadcast(shares), "lang").groupBy("bucket").agg(
        # In order of the language: sums of floats depend on it.
        F.array_sort(F.collect_list(F.struct("lang", (F.col("raw") * F.col("share")).alias("x")))).alias("parts"),
        F.sum("trusted").alias("trusted"),
    )
    total = F.aggregate("parts", F.lit(0.0), lambda a, part: a + part["x"])
    for r in scaled.select("bucket", total.alias("expected"), "trusted").collect():  # one row a bucket
        expected[r.bucket], aim[r.bucket] = r.expected, r.trusted
    return np.log((aim + PRIOR) / (expected + PRIOR)).astype(np.float32)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    trusted_rows: int = TRUSTED_ROWS,
    columns: list[str] | None = None,
) -> DataFrame:
    """Every document with its counts, base_failed, score and kept, beside the
    input `columns` (all of them by default)."""
    columns = [c for c in (docs.columns if columns is None else columns) if c not in RESULTS]
    model = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, trusted_rows))

    def judge(batches):
        for batch in batches:
            parts = []
            for _, _, block in text_blocks(batch.column("text")):
                counts = base_counts(block)
                buckets, bounds = ngram_buckets(block)
                sums = np.concatenate(([0.0], np.cumsum(model.value[buckets], dtype=np.float64)))
                n = np.diff(bounds)
                counts["score"] = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)
                parts.append(counts)
            if not parts:
                continue
            got = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
            got |= {"base_failed": failed, "kept": ~failed & (got["score"] >= threshold)}
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], *[pa.array(got[k]) for k in RESULTS]], [*columns, *RESULTS]
            )

    kinds = {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "score": T.DoubleType()}
    schema = T.StructType(
        [docs.schema[c] for c in columns] + [T.StructField(k, kinds.get(k, T.LongType())) for k in RESULTS]
    )
    needed = list(dict.fromkeys([*columns, "text"]))
    return docs.select(*needed).mapInArrow(tidy(judge), schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=["doc_id"])
