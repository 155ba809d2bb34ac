"""Features to index entries: bounds under a policy for nulls, dimensions and
the antimeridian."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.wkb import wkb_bounds

#: A column of WKB bounds; features that have it already aren't decoded again.
MEASURED = "__bounds"
POLICIES = ("planar", "reject", "split", "expand")


class EnvelopeError(ValueError):
    pass


def measured(features: DataFrame) -> DataFrame:
    """Features with their bounds beside them."""
    return features if MEASURED in features.columns else features.withColumn(MEASURED, wkb_bounds(F.col("geometry")))


def detected_dims(bounds: DataFrame) -> str:
    """xy, xyz, xym or xyzm over all geometries."""
    found = bounds.agg(F.bool_or("__bounds.has_z").alias("z"), F.bool_or("__bounds.has_m").alias("m")).first()
    return "xy" + "z" * bool(found.z) + "m" * bool(found.m)


def scan_envelopes(features: DataFrame, nulls: str = "skip", policy: str = "planar", dims: str = "auto") -> DataFrame:
    """Entries (min_x, ..., row_number, part, feature_id and the features' other
    columns) of features with a WKB geometry.

    nulls: "skip" or "error" for null and empty geometries. policy: "planar"
    takes coordinates as they are; the others take the shortest arc of
    longitudes, and a feature that crosses the antimeridian is an error
    ("reject"), two entries numbered 0 and 1 ("split"), or as wide as the world
    ("expand"). dims: "2d", "3d" (an error without Z), or "auto".
    """
    if policy not in POLICIES or nulls not in ("skip", "error") or dims not in ("auto", "2d", "3d"):
        raise EnvelopeError(f"unknown option: {nulls}, {policy}, {dims}")
    rows = measured(features)
    if nulls == "error":
        rows = rows.withColumn(MEASURED, F.when(F.col("__bounds.kind").isNull(), F.raise_error(F.lit("a geometry is null or empty"))).otherwise(F.col(MEASURED)))
    rows = rows.filter(F.col("__bounds.kind").isNotNull())
    if dims == "auto":
        dims = "3d" if "z" in detected_dims(rows) else "2d"
    crossing = F.col("__bounds.west") > F.col("__bounds.east")
    part = F.lit(None).cast("int")
    plain = F.struct(F.col("__bounds.min_x").alias("min_x"), F.col("__bounds.max_x").alias("max_x"), part.alias("part"))
    arc = F.struct(F.col("__bounds.west").alias("min_x"), F.col("__bounds.east").alias("max_x"), part.alias("part"))
    if policy == "planar":
        spans = F.array(plain)
    elif policy == "reject":
        spans = F.array(F.when(crossing, F.raise_error(F.lit("a geometry crosses the antimeridian"))).otherwise(arc))
    elif policy == "split":
        one = F.struct(F.col("__bounds.west").alias("min_x"), F.lit(180.0).alias("max_x"), F.lit(0).alias("part"))
        two = F.struct(F.lit(-180.0).alias("min_x"), F.col("__bounds.east").alias("max_x"), F.lit(1).alias("part"))
        spans = F.when(crossing, F.array(one, two)).otherwise(F.array(arc))
    else:
        world = F.struct(F.lit(-180.0).alias("min_x"), F.lit(180.0).alias("max_x"), part.alias("part"))
        spans = F.array(F.when(crossing, world).otherwise(arc))
    rows = rows.withColumn("span", F.explode(spans))
    z = {}
    if dims == "3d":
        missing = F.raise_error(F.lit("a geometry has no z"))
        z = {f"{s}_z": F.when(F.col("__bounds.has_z"), F.col(f"__bounds.{s}_z")).otherwise(missing.cast("double")) for s in ("min", "max")}
    kept = [c for c in features.columns if c not in (MEASURED, "part", "min_x", "min_y", "max_x", "max_y", "min_z", "max_z")]
    low = [F.col("span.min_x").alias("min_x"), F.col("__bounds.min_y").alias("min_y"), *([z["min_z"].alias("min_z")] if z else [])]
    high = [F.col("span.max_x").alias("max_x"), F.col("__bounds.max_y").alias("max_y"), *([z["max_z"].alias("max_z")] if z else [])]
    return rows.select(*low, *high, F.col("span.part").alias("part"), *kept, F.col("__bounds.kind").alias("geometry_kind"))
