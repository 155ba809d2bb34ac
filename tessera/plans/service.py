"""Searches as a service would answer them: checked parameters in, a page of
rows and an envelope out. There is no network here."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifact import ORDER, Artifact, Query, dedupe_features, open_artifact

DEFAULT_LIMIT, MAX_LIMIT = 100, 10_000
SEARCH = {"bbox", "limit", "offset", "predicate", "level", "payload", "identity"}
ITEMS = {"bbox", "limit", "offset", "predicate"}


class RequestError(ValueError):
    def __init__(self, code: str, message: str, status: int = 400):
        super().__init__(message)
        self.code, self.status = code, status


@dataclass(frozen=True)
class Collection:
    id: str
    title: str
    artifact: Artifact

    @property
    def capabilities(self) -> dict:
        plan = self.artifact.manifest.payload
        return {
            "predicates": ["bbox"] + (["intersects"] if plan in ("row-wkb", "feature-json") and self.artifact.manifest.dims == 2 else []),
            "levels": ["entry"] + (["feature"] if plan != "none" else []),
            "items": plan == "feature-json",
        }

    def summary(self) -> dict:
        return {"id": self.id, "title": self.title, "numberOfItems": self.artifact.manifest.items, "extent": self.artifact.manifest.extent}

    def detail(self) -> dict:
        return self.summary() | {"payloadKind": self.artifact.manifest.payload, "dims": self.artifact.manifest.dims, "capabilities": self.capabilities}


class Catalog:
    """Collections by id, from {id: {"path": ..., "title": ...}}."""

    def __init__(self, spark: SparkSession, entries: dict[str, dict]):
        self.collections = {}
        for name, entry in entries.items():
            if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
                raise RequestError("invalid_catalog", f"bad collection id {name!r}", 500)
            if unknown := set(entry) - {"path", "title"}:
                raise RequestError("invalid_catalog", f"unknown keys {sorted(unknown)}", 500)
            self.collections[name] = Collection(name, entry.get("title", name), open_artifact(spark, entry["path"]))

    def get(self, name: str) -> Collection:
        if name not in self.collections:
            raise RequestError("collection_not_found", f"no collection {name}", 404)
        return self.collections[name]

    def list(self) -> list[dict]:
        return [c.summary() for _, c in sorted(self.collections.items())]


def parse_bbox(text: str | None, dims: int) -> tuple[float, ...]:
    try:
        found = tuple(float(v) for v in (text or "").split(","))
    except ValueError:
        raise RequestError("invalid_bbox", "bbox needs numbers") from None
    if len(found) != 2 * dims or not all(map(math.isfinite, found)):
        raise RequestError("invalid_bbox", f"bbox needs {2 * dims} finite numbers")
    if any(lo > hi for lo, hi in zip(found[:dims], found[dims:])):
        raise RequestError("invalid_bbox", "bbox bounds are crossed")
    return found


def parse_page(params: dict[str, str]) -> tuple[int, int]:
    try:
        limit, offset = int(params.get("limit", DEFAULT_LIMIT)), int(params.get("offset", 0))
    except ValueError:
        raise RequestError("invalid_page", "limit and offset are whole numbers") from None
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise RequestError("invalid_page", f"limit lies in 1..{MAX_LIMIT}, offset is 0 or more")
    return limit, offset


def _choice(params: dict[str, str], name: str, allowed: tuple[str, ...], default: str) -> str:
    value = params.get(name, default)
    if value not in allowed:
        raise RequestError(f"invalid_{name}", f"{name} is one of {', '.join(allowed)}")
    return value


def _checked(params: dict[str, str], allowed: set[str]) -> None:
    if unknown := set(params) - allowed:
        raise RequestError("unknown_parameter", f"unknown parameters {sorted(unknown)}")


def resolve_shape(collection: Collection, params: dict[str, str]) -> tuple[str, str, str]:
    """(level, payload, identity) after defaults and what the artifact can do."""
    manifest = collection.artifact.manifest
    payload = _choice(params, "payload", ("none", "summary", "full"), "none")
    refs = manifest.payload != "none"
    level = _choice(params, "level", ("feature", "entry"), "feature" if refs else "entry")
    if level == "feature" and not refs:
        raise RequestError("unsupported_level", "the collection has no features", 422)
    identity = _choice(params, "identity", ("ref", "full"), "full" if manifest.stores_feature_ids or payload == "full" else "ref")
    if identity == "full" and not manifest.stores_feature_ids and payload != "full":
        raise RequestError("unsupported_identity", "the collection stores no feature ids", 422)
    return level, payload, identity


def search(collection: Collection, params: dict[str, str]) -> tuple[dict, DataFrame]:
    """(envelope with numberMatched, the page's rows). The count and the page are
    two jobs; the page is a bounded top-k by canonical order."""
    _checked(params, SEARCH)
    artifact = collection.artifact
    level, payload, identity = resolve_shape(collection, params)
    predicate = _choice(params, "predicate", ("bbox", "intersects"), "bbox")
    if predicate not in collection.capabilities["predicates"]:
        raise RequestError("unsupported_predicate", "the collection stores no geometry to test", 422)
    limit, offset = parse_page(params)
    bounds = parse_bbox(params.get("bbox"), artifact.manifest.dims)
    query = Query("box" if len(bounds) == 4 else "box3d", bounds)
    found = artifact.exact(query) if predicate == "intersects" else artifact._found(query)
    if level == "feature":
        found = dedupe_features(found)
    order = ORDER if artifact.manifest.payload != "none" else ("entry_id",)
    page = found.orderBy(*[F.col(c).asc_nulls_first() for c in order]).offset(offset).limit(limit)
    columns = ["entry_id"]
    if artifact.manifest.payload != "none":
        columns += ["row_number", "part"] + (["feature_id"] if identity == "full" else [])
    if payload != "none" and "geometry" in found.columns:
        page = page.withColumn("payload_len", F.octet_length("geometry").cast("long"))
        columns += ["payload_len"] + ([c for c in ("geometry", "properties") if c in found.columns] if payload == "full" else [])
    envelope = {
        "collectionId": collection.id, "query": {"bbox": list(bounds), "predicate": predicate, "level": level, "limit": limit, "offset": offset},
        "payloadKind": artifact.manifest.payload, "numberMatched": found.count(),
    }
    return envelope, page.select(*columns)


def items(collection: Collection, params: dict[str, str]) -> dict:
    """A page as a FeatureCollection; at most `limit` features reach the driver."""
    from tessera.sources.wkb import decode, to_geojson

    _checked(params, ITEMS)
    if not collection.capabilities["items"]:
        raise RequestError("unsupported_items", "the collection stores no features", 422)
    envelope, page = search(collection, {**params, "payload": "full", "identity": "full"})
    features = []
    for r in page.collect():
        feature = {"type": "Feature", "geometry": to_geojson(decode(bytes(r.geometry))), "properties": json.loads(r.properties or "null")}
        features.append(feature | ({"id": r.feature_id} if r.feature_id is not None else {}))
    return {"type": "FeatureCollection", "numberMatched": envelope["numberMatched"], "numberReturned": len(features), "features": features}
