"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target share of the token
budget, and its repetition rate is target / size. A document is emitted
floor(rate) times, plus once more if a hash of its id and a seed, read as a
number in [0, 1), lies below the rate's fraction: a Bernoulli draw that every
rerun repeats.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source of size 0 has target 0 and its documents are not
taken; repeated rows are drawn alike (the draw depends on the id only); an
empty table gives an empty mix. Columns of the input that are named like the
plan's are replaced by the plan's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

WORD = r"[^\x20\x09-\x0D]+"

#: A table of one row for each source is broadcast up to this many rows
#: (about 100 bytes each); beyond it, Spark joins by shuffle and splits skew.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """`sizes` has one row (source, source_size) for each source.

    Adds `target`: sources by code point, null last, get `weights` in turn and
    share `budget` times all tokens; a target stops at `cap` times the
    source's size, and what it can't take goes to the others by weight. With
    sources in order of cap / weight, those that reach their cap are a prefix,
    so running sums find the common level without rounds of resharing.
    """
    if not 0 <= budget <= cap:
        raise ValueError("the budget must lie between 0 and the cap")
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    ranked = sizes.select("source", "source_size", weight.alias("w")).select(
        "*", (F.lit(cap) * F.col("source_size")).alias("most"), F.sum("w").over(everything).alias("w_all"),
        (F.lit(budget) * F.sum("source_size").over(everything)).alias("tokens"),
    )
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    run = ranked.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("most_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    ).withColumn(
        "full",
        (F.col("tokens") - F.col("most_before")) * F.col("w")
        >= F.col("most") * (F.col("w_all") - F.col("w_before")),
    )
    free_w = F.col("w_all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(everything), F.lit(0.0))
    left = F.col("tokens") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0.0))
    return run.select(
        "source", "source_size", "w", "most", "full", free_w.alias("free_w"), left.alias("left")
    ).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("most")).otherwise(F.col("left") * F.col("w") / F.col("free_w")).alias("target"),
    )


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of id and seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|" + seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def mixing_plan(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: str = "mix-1"
) -> DataFrame:
    """`docs` (doc_id, source, text and any others) with size, source_size,
    target and copies.

    The per-source sums are combined before they are shuffled, so a hot source
    costs one row a task; the join sends the small table to the documents and
    moves no document.
    """
    added = ("size", "source_size", "target", "copies")
    sized = docs.select(*[c for c in docs.columns if c not in added], n_words(F.col("text")).alias("size"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(per_source, weights, budget, cap), "mix").select(
        F.col("source").alias("__source"), "source_size", "target"
    )
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("__rate")
    extra = (draw(F.col("doc_id"), seed) < F.col("__rate") - whole).cast("long")
    return (
        sized.join(targets, sized["source"].eqNullSafe(targets["__source"]))
        .withColumn("__rate", rate)
        .withColumn("copies", whole + extra)
        .drop("__rate", "__source")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as its plan says, with the
    columns of `docs`."""
    plan = mixing_plan(docs, **options)
    return (
        plan.filter(F.col("copies") > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(*docs.columns)
    )


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixing_plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS tokens FROM per
), run AS (
  SELECT *, sum(w) OVER () AS w_all,
         coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most_before,
         coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM weighed
), flagged AS (
  SELECT *, (tokens - most_before) * w >= most * (w_all - w_before) AS is_full FROM run
), aims AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN most ELSE (tokens - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)) * w / (w_all - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0)) END AS target
  FROM flagged
), rated AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null') || '|mix-1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
