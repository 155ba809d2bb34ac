"""Line dedup over a whole corpus, with DataFrame functions only.

Lines are normalised, hashed to 128 bits and counted once for each document
that has them; lines whose key is found in too many documents go, and each
document is put together again from the positions that stay.

Text moves once at most. Only hashes and positions travel to be counted and
matched; pairs of line and document are made distinct first and counts are
combined before their shuffle, so a line that every document has costs one row
a task there. The frequent keys and the positions to drop are written and read
again, so that Spark knows their size: it broadcasts them below its threshold,
and beyond it adaptive execution can split a hot key, since both sides of the
join come straight from a shuffle.

Defined cases: a null or empty text is one empty line; an empty key never
counts while `min_key_chars` is 1 or more; rows of the same doc_id are one
document for the count and rows without one aren't counted, as in the SQL, but
lose frequent lines like all others; a document whose lines all go keeps an
empty text; an empty table gives an empty table. Clashing columns named like
the statistics are replaced by them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

BLANKS = " \t\n\v\f\r"


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased, all else as it is."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit("second"), key).alias("__h2")]


def frequent_lines(lines: DataFrame, min_docs: int, min_key_chars: int) -> DataFrame:
    """Hashes of the keys that `min_docs` or more documents of `lines` (doc_id and
    an array column `__lines`) have."""
    keys = lines.select("doc_id", F.explode(F.array_distinct(F.transform("__lines", line_key))).alias("__key"))
    return (
        keys.filter(F.length("__key") >= min_key_chars)
        .select("doc_id", *_hashes(F.col("__key")))
        .groupBy("__h1", "__h2")
        .agg(F.count_distinct("doc_id").alias("__docs"))
        .filter(F.col("__docs") >= min_docs)
        .select("__h1", "__h2")
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, stats: bool = False) -> DataFrame:
    """`docs` with every line gone whose key is in `min_docs` or more
    documents. `stats` adds n_lines (before) and n_dropped."""
    kept = [c for c in docs.columns if not (stats and c in ("n_lines", "n_dropped"))]
    whole = docs.select(
        *kept,
        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("__lines"),
        F.xxhash64("text").alias("__hash"),
    )
    slim = whole.select("doc_id", "__hash", "__lines")
    frequent = materialise(frequent_lines(slim, min_docs, min_key_chars), "lines")
    # Repeated rows share id and hash; what falls in one falls in all of them.
    hits = (
        slim.select("doc_id", "__hash", F.posexplode(F.transform("__lines", line_key)).alias("__pos", "__key"))
        .filter(F.length("__key") >= min_key_chars)
        .select("doc_id", "__hash", "__pos", *_hashes(F.col("__key")))
        .join(frequent, ["__h1", "__h2"])
        .groupBy("doc_id", "__hash")
        .agg(F.collect_set("__pos").alias("__gone"))
        .select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__id_hash"), "__gone")
    )
    hits = materialise(hits, "drops")
    joined = whole.join(
        hits, whole["doc_id"].eqNullSafe(hits["__id"]) & (whole["__hash"] == hits["__id_hash"]), "left"
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    rebuilt = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(rebuilt)
    counts = [
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    ]
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in kept], *(counts if stats else []))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_key_chars=1, stats=True).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), flagged AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
