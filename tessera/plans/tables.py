"""Boxes, points, rays and triangles derived from the supplied tables by whole
numbers, the same in every engine: as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# name: (table, [(column, expression)])
DERIVED = {
    "boxes": ("part", [
        ("item_id", "p_partkey"),
        ("min_x", "CAST((p_partkey * 37) % 1000 AS DOUBLE)"), ("min_y", "CAST((p_partkey * 91) % 1000 AS DOUBLE)"),
        ("max_x", "CAST((p_partkey * 37) % 1000 + p_size % 10 AS DOUBLE)"), ("max_y", "CAST((p_partkey * 91) % 1000 + p_size % 7 AS DOUBLE)"),
    ]),
    "boxes3": ("part", [
        ("item_id", "p_partkey"),
        ("min_x", "CAST((p_partkey * 37) % 1000 AS DOUBLE)"), ("min_y", "CAST((p_partkey * 91) % 1000 AS DOUBLE)"), ("min_z", "CAST((p_partkey * 53) % 1000 AS DOUBLE)"),
        ("max_x", "CAST((p_partkey * 37) % 1000 + p_size % 10 AS DOUBLE)"), ("max_y", "CAST((p_partkey * 91) % 1000 + p_size % 7 AS DOUBLE)"), ("max_z", "CAST((p_partkey * 53) % 1000 + p_size % 5 AS DOUBLE)"),
    ]),
    "regions": ("supplier", [
        ("item_id", "s_suppkey"),
        ("min_x", "CAST((s_suppkey * 71) % 1000 AS DOUBLE)"), ("min_y", "CAST((s_suppkey * 29) % 1000 AS DOUBLE)"),
        ("max_x", "CAST((s_suppkey * 71) % 1000 + 5 + s_suppkey % 40 AS DOUBLE)"), ("max_y", "CAST((s_suppkey * 29) % 1000 + 5 + s_suppkey % 31 AS DOUBLE)"),
    ]),
    "regions3": ("supplier", [
        ("item_id", "s_suppkey"),
        ("min_x", "CAST((s_suppkey * 71) % 1000 AS DOUBLE)"), ("min_y", "CAST((s_suppkey * 29) % 1000 AS DOUBLE)"), ("min_z", "CAST((s_suppkey * 17) % 1000 AS DOUBLE)"),
        ("max_x", "CAST((s_suppkey * 71) % 1000 + 50 + s_suppkey % 40 AS DOUBLE)"), ("max_y", "CAST((s_suppkey * 29) % 1000 + 50 + s_suppkey % 31 AS DOUBLE)"), ("max_z", "CAST((s_suppkey * 17) % 1000 + 60 AS DOUBLE)"),
    ]),
    "places": ("customer", [
        ("item_id", "c_custkey"),
        ("lon", "CAST((c_custkey * 73) % 36000 AS DOUBLE) / 100 - 180"), ("lat", "CAST((c_custkey * 131) % 18000 AS DOUBLE) / 100 - 90"), ("name", "c_name"), ("segment", "c_mktsegment"),
    ]),
    "sites": ("supplier", [("query_id", "s_suppkey"), ("x", "CAST((s_suppkey * 613) % 1000 AS DOUBLE)"), ("y", "CAST((s_suppkey * 377) % 1000 AS DOUBLE)")]),
    "rays": ("supplier", [
        ("ray_id", "s_suppkey"),
        ("ox", "CAST((s_suppkey * 41) % 1000 AS DOUBLE)"), ("oy", "CAST((s_suppkey * 83) % 1000 AS DOUBLE)"), ("oz", "CAST((s_suppkey * 19) % 1000 AS DOUBLE)"),
        ("dx", "CAST(s_suppkey % 5 - 2 AS DOUBLE)"), ("dy", "CAST(s_suppkey % 3 - 1 AS DOUBLE)"), ("dz", "CAST(s_suppkey % 7 - 3 AS DOUBLE)"),
        ("max_t", "CAST(20 + s_suppkey % 50 AS DOUBLE)"),
    ]),
    "triangles": ("part", [
        ("item_id", "p_partkey"),
        *[(f"{c}{a}", f"CAST((p_partkey * {m}) % 100 AS DOUBLE)" if c == "a" else f"CAST((p_partkey * {m}) % 100 + (p_partkey * {n}) % 17 - 8 AS DOUBLE)")
          for c, n in (("a", 0), ("b", 7), ("c", 11)) for a, m in (("x", 37), ("y", 91), ("z", 53)) for n in [n + m % 5]],
    ]),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = DERIVED[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*[F.expr(e).alias(c) for c, e in columns])


def derived_sql(*names: str) -> str:
    """A WITH clause of the same tables."""
    parts = []
    for name in names:
        table, columns = DERIVED[name]
        own = ", ".join(f'{e} AS "{c}"' for c, e in columns)
        parts.append(f"{name} AS (SELECT {own} FROM {table})")
    return "WITH " + ", ".join(parts)
