"""Blocked Bloom filters as arrays of 64-bit words, with DataFrame functions only.

All bits of a key lie in one word: 40 bits of a hash choose the word, four
times six bits the places in it. Filters are built with one combined
aggregation and tested with a look at one word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
BITS = 4


def n_words(keys):
    """Words for a number of keys (an int or a column)."""
    if isinstance(keys, Column):
        return F.ceil(keys * BITS_PER_KEY / 64).cast("long")
    return max(1, -(-keys * BITS_PER_KEY // 64))


def _hash(key: Column, level: int) -> Column:
    return F.xxhash64(F.lit(level), key)


def _word(key: Column, level: int, size) -> Column:
    return F.pmod(F.shiftrightunsigned(_hash(key, level), 24), F.lit(size) if isinstance(size, int) else size)


def _mask(key: Column, level: int) -> Column:
    """The key's places in its word."""
    h = _hash(key, level)
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def holds(key: Column, level: int, size, words: Column) -> Column:
    """Whether the filter may hold the key: surely, if it was built over it."""
    mask = _mask(key, level)
    return F.get(words, _word(key, level, size).cast("int")).bitwiseAND(mask) == mask


def words(keys: DataFrame, level: int, size: int) -> DataFrame:
    """One row with the filter of `keys` (a column key)."""
    key = F.col("key")
    bits = keys.select(_word(key, level, size).alias("word"), _mask(key, level).alias("bits"))
    blank = keys.sparkSession.range(size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    return _together(bits.union(blank).groupBy("word").agg(F.bit_or("bits").alias("bits")))


def sharded_words(keys: DataFrame, level: int, sizes: DataFrame) -> DataFrame:
    """(shard, n_words, words): a filter for each shard of `keys` (key, shard),
    with the number of words that `sizes` (shard, n_words) says."""
    key, size = F.col("key"), F.col("n_words")
    bits = keys.join(sizes, "shard").select("shard", _word(key, level, size).alias("word"), _mask(key, level).alias("bits"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("word")
    blank = sizes.select("shard", every, F.lit(0).cast("long").alias("bits"))
    joined = bits.union(blank).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    return _together(joined, "shard").join(sizes, "shard").select("shard", "n_words", "words")


def _together(joined: DataFrame, *by: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return joined.groupBy(*by).agg(F.transform(ordered, lambda x: x["bits"]).alias("words"))
