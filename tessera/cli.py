"""Command line: discover, inspect, validate, build and query.

python -m tessera.cli discover FILE
python -m tessera.cli validate FILE [--payload P] [--exact]
python -m tessera.cli build SOURCE ARTIFACT [--payload row-wkb] [--dims auto] [--nulls skip] [--precision f64] [--antimeridian planar]
    [--column NAME] [--include A,B | --exclude A,B | --no-properties]
python -m tessera.cli query ARTIFACT (--bbox X,Y,X,Y | --radius LON,LAT,METRES) [--exact] [--count] [--limit N [--offset N]]
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.artifact import ORDER, PLANS, Query, convert, open_artifact
from tessera.sources import features, flatgeobuf, inspect
from tessera.sources.records import projected_properties


JSON_SUFFIXES = (".json", ".geojson", ".ndjson", ".geojsonl")


def discover_source(spark: SparkSession, path: str) -> features.Discovery:
    """By the suffix: GeoJSON by reading it, FlatGeobuf from its header, anything else from a Parquet footer."""
    if path.endswith(JSON_SUFFIXES):
        return features.discover_features(read_source(spark, path))
    return flatgeobuf.discover_flatgeobuf(path) if path.endswith(".fgb") else features.discover(path)


def read_source(spark: SparkSession, path: str, column: str | None = None, properties: str = "all", names: Sequence[str] = ()) -> DataFrame:
    """Features; of a Parquet file only the projected properties are read."""
    if path.endswith(JSON_SUFFIXES[:2]):
        return features.read_geojson(spark, path)
    if path.endswith(JSON_SUFFIXES):
        return features.read_geojson_lines(spark, path)
    if path.endswith(".fgb"):
        return flatgeobuf.read_flatgeobuf(spark, path)
    found = features.discover(path)
    own = found.select(column)
    kept = projected_properties([n for n, _ in found.schema], own.name, properties, names)
    return features.read_parquet_features(spark, path, own.name, kept, encoding=own.encoding)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("discover", "inspect", "validate"):
        one = commands.add_parser(name)
        one.add_argument("source")
        one.add_argument("--column")
        one.add_argument("--payload", choices=PLANS, default="none")
        one.add_argument("--exact", action="store_true")
    build = commands.add_parser("build")
    build.add_argument("source")
    build.add_argument("artifact")
    build.add_argument("--payload", choices=PLANS, default="row-wkb")
    build.add_argument("--dims", choices=("auto", "2d", "3d"), default="auto")
    build.add_argument("--nulls", choices=("skip", "error"), default="skip")
    build.add_argument("--precision", choices=("f64", "f32"), default="f64")
    build.add_argument("--antimeridian", choices=("planar", "reject", "split", "expand"), default="planar")
    build.add_argument("--column")
    some = build.add_mutually_exclusive_group()
    some.add_argument("--include")
    some.add_argument("--exclude")
    some.add_argument("--no-properties", action="store_true")
    query = commands.add_parser("query")
    query.add_argument("artifact")
    query.add_argument("--bbox")
    query.add_argument("--radius")
    query.add_argument("--exact", action="store_true")
    query.add_argument("--count", action="store_true")
    query.add_argument("--limit", type=int)
    query.add_argument("--offset", type=int)
    return top


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """Lines of output; wrong combinations end with a usage error."""
    top = parser()
    args = top.parse_args(argv)
    if args.command in ("discover", "inspect", "validate"):
        found = discover_source(spark, args.source)
        if args.command == "discover":
            return [json.dumps(asdict(found))]
        rows = read_source(spark, args.source, args.column) if args.exact else None
        report = inspect.validate(found, rows, args.column, args.payload)
        if args.command == "inspect":
            return [json.dumps(asdict(report.profile) if report.profile else None)]
        return [json.dumps({"ok": report.ok, "issues": [asdict(i) for i in report.issues]})]
    if args.command == "build":
        kind = "none" if args.no_properties else "include" if args.include else "exclude" if args.exclude else "all"
        names = (args.include or args.exclude or "").split(",")
        rows = read_source(spark, args.source, args.column, kind, names)
        made = convert(
            rows, args.artifact, args.payload, args.nulls, args.antimeridian, args.dims, args.precision, properties=kind, names=names
        )
        return [json.dumps(asdict(made.manifest))]
    if (args.bbox is None) == (args.radius is None):
        top.error("one of --bbox and --radius is needed")
    exact = args.exact or args.radius is not None
    if exact and (args.count or args.limit is not None):
        top.error("--count and paging don't go with an exact test")
    if args.offset is not None and args.limit is None:
        top.error("--offset needs --limit")
    artifact = open_artifact(spark, args.artifact)
    values = tuple(float(v) for v in (args.bbox or args.radius).split(","))
    if exact and artifact.manifest.dims != 2:
        top.error("exact tests are 2D")
    query = Query("radius" if args.radius else "box" if len(values) == 4 else "box3d", values)
    if args.count:
        return [str(artifact.count_entries(query))]
    found = artifact.exact(query) if exact else artifact.headers(query)
    order = [c for c in ORDER if c in found.columns]
    found = found.select(*order).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    if args.limit is not None:
        found = found.offset(args.offset or 0).limit(args.limit)
    return found.toJSON().collect() if args.limit is not None else list(found.toJSON().toLocalIterator())


def main() -> None:
    for line in run(SparkSession.builder.appName("tessera").getOrCreate(), sys.argv[1:]):
        print(line)


if __name__ == "__main__":
    main()
