"""URL filters, with DataFrame functions only.

Rules name a host (with its subdomains) and the start of a path; the longest
rule that fits decides. What no rule decides is looked up in a list of blocked
domains through a cascade of Bloom filters: level 0 encodes the listed keys,
level 1 the keys of the corpus that level 0 takes for listed though they
aren't, level 2 the listed keys that level 1 takes wrongly, and so on until no
key of the corpus is taken wrongly. For every key of the corpus the cascade
gives exact membership, and no row of it is joined: the levels are a few bit
arrays that travel with the plan as scalars.

A url's keys are its host and the domains above it, as far as listed domains
have labels. A key's bits lie in one word of a level, so a test is one hash, one
look and one comparison. The arrays have a checked size (`max_bits` for all
levels). A list that needs more is dealt over shards by a hash of the key, each
with a cascade of its own; distinct hosts are tested there, each key with the
arrays of its shard, and only their verdicts are brought to the urls.

The query reads its list from the table blocked_domains (a column key) beside
pages. Where there is none, it takes a stand-in: six made-up host names, found
in the given pages, in three zones, 18 domains whatever the corpus. The SQL
says the stand-in only.

Defined cases: a null url, or one without "://", has an empty host and path,
fits no rule and is allowed; repeated rows are judged alike; an empty table or
list is fine; other columns pass through, those named like the results are
replaced.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .storage import materialise

#: (host, start of the path, verdict), as the task states them.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Domains that the registered query blocks where no rule decides and no list is given.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_ZONES = ("example.com", "example.net", "example.org")

MAX_BITS = 1 << 26
MAX_SHARDS = 4096
#: Keys of a host up to this number are tested one by one, more of them in a loop.
UNROLLED = 6


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    found = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(found, string.ascii_uppercase, string.ascii_lowercase)).otherwise("")


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    found = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, found).otherwise("")


def within(host: Column, domain: str) -> Column:
    return (host == domain) | F.endswith(host, F.lit("." + domain))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """`value(rule)` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        found = F.when(within(host, rule[0]) & F.startswith(path, F.lit(rule[1])), value(rule)).otherwise(found)
    return found


def domains(host: Column, depth: int) -> list[Column]:
    """The last 1, 2, ... `depth` labels of a host; null where it has fewer."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return [F.when((n >= k) & (host != ""), F.array_join(F.slice(labels, -k, k), ".")) for k in range(1, depth + 1)]


class Cascade:
    """Levels of (number of words, one-row table of a word array)."""

    def __init__(self, levels: list[tuple[int, DataFrame]]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """Exact for the keys that the cascade was built over."""
        return _walk(key, [(n, words.scalar()) for n, words in self.levels])


def _walk(key: Column, levels: list[tuple[int | Column, Column]]) -> Column:
    """The first level that doesn't hold the key tells: even levels hold listed keys."""
    found = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        n_words, words = levels[level]
        found = F.when(bloom.holds(key, level, n_words, words), found).otherwise(F.lit(level % 2 == 1))
    return found if levels else F.lit(False)


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """`universe` is a stored table (key, listed) of distinct keys. None if the
    levels would need more than `max_bits`."""
    levels, spent = [], 0
    encode, other = universe.filter("listed"), universe.filter("NOT listed")
    size = encode.count()
    while size:
        n_words = bloom.n_words(size)
        spent += 64 * n_words
        if spent > max_bits:
            return None
        level = len(levels)
        words = materialise(bloom.words(encode, level, n_words), "bloom")
        levels.append((n_words, words))
        wrong = other.filter(bloom.holds(F.col("key"), level, n_words, words.scalar()))
        encode, other = wrong, encode
        size = encode.count()
    return Cascade(levels)


def sharded_hits(universe: DataFrame, keyed: DataFrame, shards: int) -> DataFrame:
    """The rows of `keyed` (with a column key) that the list has, by one cascade
    for each shard of the keys. A level's arrays are one row a shard, and a key
    meets its shard's rows only; levels are built for all shards at once."""
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.col("key")), F.lit(shards)).cast("int")
    universe = universe.withColumn("shard", shard)
    probes = keyed.withColumn("shard", shard).withColumns({"__open": F.lit(True), "__hit": F.lit(False)})
    encode, other, level = universe.filter("listed"), universe.filter("NOT listed"), 0
    while encode.limit(1).count():
        sizes = encode.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        sizes = materialise(sizes.select("shard", bloom.n_words(F.col("n")).alias("n_words")), "shards")
        words = materialise(bloom.sharded_words(encode, level, sizes), "bloom")
        inside = F.coalesce(bloom.holds(F.col("key"), level, F.col("n_words"), F.col("words")), F.lit(False))
        wrong = materialise(other.join(words, "shard").filter(inside).select(*other.columns), "wrong")
        met = probes.join(words, "shard", "left")
        out = F.col("__open") & ~inside  # decided here; a shard without this level holds no key of it
        hit = F.when(out, F.lit(level % 2 == 1)).otherwise(F.when(F.col("__open"), F.lit(level % 2 == 0)).otherwise(F.col("__hit")))
        probes = met.select(*[c for c in probes.columns if c not in ("__open", "__hit")], (F.col("__open") & inside).alias("__open"), hit.alias("__hit"))
        encode, other, level = wrong, encode, level + 1
    return probes.filter("__hit").drop("__open", "__hit", "shard")


def key_universe(hosts: DataFrame, listed: DataFrame, depth: int) -> DataFrame:
    """Distinct keys of the corpus, with whether the list has them."""
    distinct = hosts.select("host").distinct()
    keys = distinct.select(F.explode(F.array(*domains(F.col("host"), depth))).alias("key")).filter("key IS NOT NULL").distinct()
    marks = listed.select(F.col("key")).distinct().withColumn("listed", F.lit(True))
    return keys.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bits: int = MAX_BITS
) -> DataFrame:
    """`pages` with host, path, rule and verdict. `listed` has a column key of
    blocked domains in lower case."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.withColumns(
        {"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))}
    )
    depth = listed.agg(F.max(F.size(F.split("key", r"\.", -1)))).first()[0] or 0
    host, path = F.col("host"), F.col("path")
    named = longest_rule(host, path, rules, lambda r: F.lit(r[0] + r[1]))
    ruled = longest_rule(host, path, rules, lambda r: F.lit(r[2]))
    if not depth:
        return split.select("*", named.alias("rule"), F.coalesce(ruled, F.lit("allow")).alias("verdict"))
    universe = materialise(key_universe(split, listed, depth), "keys")
    cascade = build_cascade(universe, max_bits)
    if cascade is None:
        keyed = split.select("host").distinct().select("host", F.explode(F.array(*domains(host, depth))).alias("key")).filter("key IS NOT NULL")
        needed = universe.filter("listed").count() * 2 * bloom.BITS_PER_KEY
        bad = sharded_hits(universe, keyed, min(MAX_SHARDS, -(-needed // max_bits)))
        bad = materialise(bad.select("host").distinct().withColumn("__bad", F.lit(True)), "bad")
        return split.join(bad, "host", "left").select(
            *split.columns, named.alias("rule"),
            F.coalesce(ruled, F.when(F.col("__bad"), "block").otherwise("allow")).alias("verdict"),
        )
    if depth <= UNROLLED:
        hit = reduce(lambda a, b: a | b, [F.coalesce(k.isNotNull() & cascade.contains(k), F.lit(False)) for k in domains(host, depth)])
    else:
        hit = F.exists(F.array(*domains(host, depth)), lambda k: F.coalesce(k.isNotNull() & cascade.contains(k), F.lit(False)))
    return split.select("*", named.alias("rule"), F.coalesce(ruled, F.when(hit, "block").otherwise("allow")).alias("verdict"))


def blocked_domains(spark, sf_dir: str) -> DataFrame:
    """The list table of `sf_dir`, or the stand-in where it has none."""
    try:
        return spark.read.parquet(f"{sf_dir}/blocked_domains.parquet").select(F.lower("key").alias("key")).filter("key <> ''")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([(f"{name}.{zone}",) for name in BLOCKED_NAMES for zone in BLOCKED_ZONES], "key string")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, blocked_domains(spark, sf_dir)).drop("url")


def _sql() -> str:
    keys = ", ".join(f"'{n}.{z}'" for n in BLOCKED_NAMES for z in BLOCKED_ZONES)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages
), split AS (
  SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest
), ruled AS (
  SELECT *, '.' || host AS h FROM split
), named AS (
  SELECT *, CASE WHEN h LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
                 WHEN h LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
                 WHEN h LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
                 WHEN h LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
                 WHEN h LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM ruled
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_extract(host, '([^.]*\\.[^.]*\\.[^.]*)$', 1) IN ({keys}) THEN 'block'
            ELSE 'allow' END AS verdict
FROM named
"""


OP5_SQL = _sql()
