"""Token counts through a digest cache.

A cache table holds (tokenizer digest, content digest, n_tokens), in one folder
for each tokenizer. The digests of the documents' normalised content (a null
text is the empty one; nothing else is changed, since any change could alter a
count) are made distinct and joined with the cache; only digests travel for
that. Those that the cache lacks go into a Bloom filter, so that texts which the
cache has stay where they are (but for the filter's few mistakes); the others
are combined within tasks, shuffled once by their digest and encoded, each
distinct one once, and their counts are appended.

Digests are 256 bits, so equal digests are equal texts. The counts that a call
needs are stored before they are joined with the documents, so Spark knows
their size, and adaptive execution can split the rows of a hot text.

Defined cases: null and empty texts count 0 tokens and 0 bytes; repeated rows
are counted alike; an empty table gives an empty table and appends nothing;
other columns pass through, those named like the results are replaced. Two
calls that append the same text at once leave two equal rows, read as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .storage import Scratch, exists, fresh_folder, materialise
from .tokens import encoder, tokenizer_path, version_digest
from .workers import tidy

CACHE = "content binary, n_tokens long, tokenizer string"
#: Words of the filter of missing digests (8 MB); beyond its room it lets more through.
FILTER_WORDS = 1 << 20


def content_digest(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _count(path: str):
    def count(batches):
        for batch in batches:
            for i, j, _, bounds in encoder(path).blocks(batch.column("text")):
                columns = [batch.column("content").slice(i, j - i), pa.array(np.diff(bounds))]
                yield pa.RecordBatch.from_arrays(columns, ["content", "n_tokens"])

    return count


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit. `cache` is the folder of
    the cache table, made if it isn't there."""
    spark, digest = docs.sparkSession, version_digest(tokenizer)
    scratch = Scratch(spark)
    texts = docs.select(content_digest(F.col("text")).alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = scratch.stored(texts.select("content").distinct(), "wanted")
    if exists(spark, cache):
        mine = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == digest).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        known = scratch.stored(mine.join(wanted, "content", "left_semi"), "known")
        missing = scratch.stored(wanted.join(known.select("content"), "content", "left_anti"), "missing")
    else:
        known, missing = spark.createDataFrame([], "content binary, n_tokens long"), wanted
    lacking = missing.count()
    counts = known
    if lacking:
        fresh = scratch.stored(_encoded(texts, missing, lacking, tokenizer, scratch), "fresh")
        fresh.withColumn("tokenizer", F.lit(digest)).write.partitionBy("tokenizer").mode("append").parquet(cache)
        counts = known.union(fresh)
    counts = materialise(counts.withColumnRenamed("content", "__content"), "counts")
    scratch.clear()
    columns = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    digests = docs.select(
        *columns,
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        content_digest(F.col("text")).alias("__content"),
    )
    return digests.join(counts, "__content").drop("__content").withColumn("over_limit", F.col("n_tokens") > limit)


def _encoded(texts: DataFrame, missing: DataFrame, lacking: int, tokenizer: str, scratch: Scratch) -> DataFrame:
    """(content, n_tokens) of the missing digests; one text each is moved and encoded."""
    size = min(FILTER_WORDS, bloom.n_words(lacking))
    words = scratch.stored(bloom.words(missing.select(F.col("content").alias("key")), 0, size), "filter")
    likely = texts.filter(bloom.holds(F.col("content"), 0, size, words.scalar()))
    once = likely.groupBy("content").agg(F.first("text").alias("text")).join(missing, "content", "left_semi")
    return once.select("content", "text").mapInArrow(tidy(_count(tokenizer)), "content binary, n_tokens long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """The cache starts empty at every call, so that each call's time is that
    of a whole corpus of misses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs, tokenizer_path("byte_bpe_50k.json"), fresh_folder(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
