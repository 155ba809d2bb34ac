"""Searches over a static set of boxes.

A SpatialFrame is a DataFrame with `item_id` and the bounds of a box in each
row, and whatever payload columns come with it. Every search returns a lazy
DataFrame. Frames that are built are clustered along a space-filling curve, so
that after writing, a window touches few row groups: its four comparisons are
pushed to the scan and pruned by column statistics.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions import single
from tessera.functions.boxes import (
    Box,
    box,
    box_columns,
    box_names,
    contains_point,
    distance_squared,
    extent_of,
    gap_squared,
    is_valid,
    overlaps,
)
from tessera.functions.curves import curve_key
from tessera.functions.rays import Ray, enter_t, triangle_columns, with_triangle_t
from tessera.functions.regions import Region


class InvalidBounds(ValueError):
    """A box with NaN or crossed bounds."""


class ItemCountMismatch(ValueError):
    """Another number of rows than was announced."""


class SpatialFrame:
    def __init__(self, df: DataFrame, dims: int = 2, item_id: str = "item_id"):
        missing = [c for c in [item_id, *box_names(dims)] if c not in df.columns]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        self.df, self.dims, self.item_id = df, dims, item_id

    # -- building ---------------------------------------------------------

    @classmethod
    def build(
        cls,
        df: DataFrame,
        dims: int = 2,
        item_id: str = "item_id",
        curve: str | None = "hilbert",
        bits: int = 16,
        partitions: int | None = None,
        expected_items: int | None = None,
    ) -> SpatialFrame:
        """Checks every box and clusters the rows. One pass finds the extent,
        the number of rows and any bad box; then rows are dealt by key ranges."""
        own = box_columns(dims)
        found = df.agg(*extent_of(dims), F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(is_valid(own), F.lit(False))).alias("bad")).first()
        if found["bad"]:
            raise InvalidBounds(f"{found['bad']} boxes have NaN, null or crossed bounds")
        if expected_items is not None and found["n"] != expected_items:
            raise ItemCountMismatch(f"{expected_items} items were announced, {found['n']} came")
        if not found["n"] or curve is None:
            return cls(df, dims, item_id)
        extent = [found[c] for c in box_names(dims)]
        keyed = df.withColumn("curve_key", curve_key(own, extent, curve, bits))
        dealt = keyed.repartitionByRange(partitions, "curve_key") if partitions else keyed.repartitionByRange("curve_key")
        return cls(dealt.sortWithinPartitions("curve_key", item_id), dims, item_id)

    @classmethod
    def from_points(cls, df: DataFrame, coordinates: Sequence[str], item_id: str = "item_id", **options) -> SpatialFrame:
        """Points are boxes without size."""
        dims = len(coordinates)
        bounds = {n: F.col(coordinates[k % dims]).cast("double") for k, n in enumerate(box_names(dims))}
        return cls.build(df.withColumns(bounds), dims, item_id, **options)

    @classmethod
    def from_triangles(cls, df: DataFrame, dims: int = 3, item_id: str = "item_id", **options) -> SpatialFrame:
        """Bounds of triangles whose corners are in ax, ay, ... cz."""
        bounds = {}
        for k, name in enumerate(box_names(dims)):
            corners = [F.col(f"{c}{'xyz'[k % dims]}") for c in "abc"]
            bounds[name] = (F.least if k < dims else F.greatest)(*corners).cast("double")
        return cls.build(df.withColumns(bounds), dims, item_id, **options)

    def to_single(self) -> SpatialFrame:
        """Bounds rounded outward to FLOAT: half the size, and a search finds
        every exact match and perhaps a few more."""
        return SpatialFrame(single.outward(self.df, self.dims), self.dims, self.item_id)

    # -- files ------------------------------------------------------------

    def write(self, path: str, rows_per_file: int | None = None) -> None:
        writer = self.df.write
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, dims: int = 2, item_id: str = "item_id") -> SpatialFrame:
        return cls(spark.read.parquet(path), dims, item_id)

    # -- aggregates -------------------------------------------------------

    @property
    def box(self) -> Box:
        return box_columns(self.dims)

    def extent(self) -> tuple[float, ...] | None:
        found = self.df.agg(*extent_of(self.dims)).first()
        return None if found[0] is None else tuple(float(v) for v in found)

    def count(self) -> int:
        return self.df.count()

    # -- box and region searches -----------------------------------------

    def search(self, *bounds: float) -> DataFrame:
        """Rows whose box meets the window; a window with NaN meets none."""
        return self.df.filter(overlaps(self.box, box(*bounds)))

    def stab(self, *point: float) -> DataFrame:
        return self.df.filter(contains_point(self.box, point))

    def search_region(self, region: Region) -> DataFrame:
        around = region.bounding_box()
        test = region.overlaps_box(self.box)
        return self.df.filter(test if around is None else overlaps(self.box, around) & test)

    def inside_region(self, region: Region) -> DataFrame:
        return self.df.filter(region.contains_box(self.box))

    def search_single(self, *bounds: float) -> DataFrame:
        """For frames of singles: the window's bounds become the singles that
        decide every comparison alike."""
        return self.search(*single.inward_literal(*bounds))

    def search_exact(self, exact: SpatialFrame, *bounds: float) -> DataFrame:
        """For frames of singles: candidates, confirmed on the exact boxes."""
        ids = self.search_single(*bounds).select(self.item_id)
        return exact.search(*bounds).join(ids, self.item_id, "left_semi")

    def any_exact(self, exact: SpatialFrame, *bounds: float) -> bool:
        return not self.search_exact(exact, *bounds).isEmpty()

    def first_exact(self, exact: SpatialFrame, *bounds: float) -> int | None:
        return self.search_exact(exact, *bounds).agg(F.min(self.item_id)).first()[0]

    def visit_exact(self, exact: SpatialFrame, visitor: Callable[[Row], bool | None], *bounds: float) -> bool:
        return any(visitor(row) for row in self.search_exact(exact, *bounds).toLocalIterator())

    def any(self, *bounds: float) -> bool:
        return not self.search(*bounds).isEmpty()

    def first(self, *bounds: float) -> int | None:
        """The smallest id that meets the window."""
        return self.search(*bounds).agg(F.min(self.item_id)).first()[0]

    def count_matches(self, *bounds: float) -> int:
        return self.search(*bounds).count()

    def iterate(self, *bounds: float) -> Iterator[Row]:
        """Rows one after the other; stopping early leaves later partitions unread."""
        return self.search(*bounds).toLocalIterator()

    def visit(self, visitor: Callable[[Row], bool | None], *bounds: float) -> bool:
        """Calls `visitor` for each match until it returns True."""
        return any(visitor(row) for row in self.iterate(*bounds))

    def lookup(self, *ids: int) -> DataFrame:
        return self.df.filter(F.col(self.item_id).isin(list(ids)))

    def prefixes(self, payload: str, length: int, *bounds: float) -> DataFrame:
        """Ids, the first bytes of a payload column and its length."""
        return self.search(*bounds).select(
            self.item_id, F.substring(payload, 1, length).alias("prefix"), F.octet_length(payload).cast("long").alias("payload_len")
        )

    # -- nearest neighbours ----------------------------------------------

    def _nearest(self, measure: Column, k: int | None, most: float | None, name: str) -> DataFrame:
        found = self.df.withColumn(name, measure)
        if most is not None:
            found = found.filter(F.col(name) <= F.lit(float(most)))
        found = found.orderBy(name, self.item_id)
        return found if k is None else found.limit(k)

    def neighbors(self, point: Sequence[float], k: int | None, max_distance: float | None = None) -> DataFrame:
        """The k rows nearest to a point, with distance_squared; ties go to the
        smaller id. A point that isn't finite, or a limit that is NaN or
        negative, has no neighbours. `k=None` gives all, in order."""
        if not all(map(math.isfinite, point)) or max_distance is not None and not max_distance >= 0:
            return self.df.limit(0).withColumn("distance_squared", F.lit(0.0))
        most = None if max_distance is None else max_distance * max_distance
        return self._nearest(distance_squared(self.box, point), k, most, "distance_squared")

    def neighbors_exact(self, exact: SpatialFrame, point: Sequence[float], k: int, max_distance: float | None = None) -> DataFrame:
        """For frames of singles: the k nearest by the exact boxes. Rounded boxes are never further than exact ones,
        so the k-th exact distance of any k rows bounds which rounded boxes can hold a nearer one."""
        ids = self.neighbors(point, k, max_distance).select(self.item_id)
        first = exact.df.join(F.broadcast(ids), self.item_id, "left_semi").agg(F.max(distance_squared(exact.box, point)), F.count(F.lit(1))).first()
        if not all(map(math.isfinite, point)) or max_distance is not None and not max_distance >= 0:
            return exact.neighbors(point, k, max_distance)
        near = self.df
        if first[1] >= k and first[0] is not None:
            near = near.filter(distance_squared(self.box, point) <= F.lit(float(first[0])))
        rest = exact.df.join(near.select(self.item_id), self.item_id, "left_semi")
        return SpatialFrame(rest, self.dims, self.item_id).neighbors(point, k, max_distance)

    def neighbors_of_box(self, bounds: Sequence[float], k: int | None, max_distance: float | None = None) -> DataFrame:
        if max_distance is not None and not max_distance >= 0:
            return self.df.limit(0).withColumn("distance_squared", F.lit(0.0))
        most = None if max_distance is None else max_distance * max_distance
        return self._nearest(gap_squared(self.box, box(*bounds)), k, most, "distance_squared")

    def neighbors_metric(self, metric: Callable[[Box], Column], k: int | None, max_distance: float | None = None) -> DataFrame:
        """By a metric of the caller's: a column over the stored box."""
        if max_distance is not None and not max_distance >= 0:
            return self.df.limit(0).withColumn("distance", F.lit(0.0))
        return self._nearest(metric(self.box), k, max_distance, "distance")

    # -- rays -------------------------------------------------------------

    def _on_ray(self, ray: Ray) -> DataFrame:
        around = ray.segment_box()
        near = self.df if around is None else self.df.filter(overlaps(self.box, around))
        return near.withColumn("t", enter_t(ray, self.box)).filter(F.col("t").isNotNull())

    def raycast(self, ray: Ray) -> DataFrame:
        """Rows that the ray meets, with t."""
        return self._on_ray(ray)

    def raycast_ordered(self, ray: Ray) -> DataFrame:
        return self._on_ray(ray).orderBy("t", self.item_id)

    def raycast_closest(self, ray: Ray) -> DataFrame:
        """One row (item_id, t), or none; of equal t the smaller id."""
        best = self._on_ray(ray).agg(F.min(F.struct("t", self.item_id)).alias("m")).filter("m IS NOT NULL")
        return best.select(f"m.{self.item_id}", "m.t")

    def closest_triangle(self, ray: Ray) -> DataFrame:
        """For frames of 3D triangles: those near the segment, then the exact test."""
        around = ray.segment_box()
        near = self.df if around is None else self.df.filter(overlaps(self.box, around))
        met = with_triangle_t(near, ray, triangle_columns())
        hit = F.when(F.col("t").isNotNull(), F.struct("t", self.item_id))
        best = met.agg(F.min(hit).alias("m")).filter("m IS NOT NULL")
        return best.select(f"m.{self.item_id}", "m.t")
