"""Grid joins whose tables have boxes far out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.boxes import box_columns, box_names
from tessera.functions.rays import enter_t, ray_columns
from tessera.operators import joins


def test_outliers_leave_the_grid_alone(spark):
    rng = np.random.default_rng(3)
    low = rng.uniform(0, 1000, (600, 2))
    rows = [(i, *map(float, p), *map(float, p + 8)) for i, p in enumerate(low)]
    far = [(900, 1e12, 1e12, 1e12 + 1, 1e12 + 1), (901, -1e300, 0.0, 1e300, 9.0), (902, 5.0, 5.0, float("inf"), 6.0)]
    schema = "item_id long, min_x double, min_y double, max_x double, max_y double"
    plain, mixed = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + far, schema)
    a, b = joins.cell_side([plain], 2)[0], joins.cell_side([mixed], 2)[0]
    assert abs(a - b) < 0.1 * a
    want = {(p[0], q[0]) for p in rows + far for q in rows + far if p[0] < q[0] and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert {tuple(r) for r in joins.self_join(mixed).collect()} == want


def box_table(spark, boxes, dims):
    return spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(boxes)], "item_id long, " + ", ".join(f"{n} double" for n in box_names(dims)))


def ray_table(spark, rays, dims):
    columns = [f"{p}{a} double" for p in "od" for a in "xyz"[:dims]]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rays)], ", ".join(["ray_id long", *columns, "max_t double"]))


def all_with_all(rays, boxes, dims):
    """Every ray against every box, for small tables."""
    found = rays.crossJoin(F.broadcast(boxes)).withColumn("t", enter_t(ray_columns(dims), box_columns(dims)))
    return sorted(tuple(r) for r in found.filter("t IS NOT NULL").select("ray_id", "item_id", "t").collect())


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("outlier", [False, True])
def test_long_rays(spark, dims, outlier):
    rng = np.random.default_rng(dims)
    low = rng.uniform(0, 1000, (700, dims))
    boxes = np.hstack([low, low + rng.uniform(0, 9, low.shape)])
    boxes = np.vstack([boxes, np.hstack([np.arange(0, 900, 30)[:, None].repeat(dims, 1)] * 2)])  # points on the diagonal
    if outlier:
        boxes = np.vstack([boxes, [1e9] * dims + [1e9 + 1] * dims, [-np.inf] * dims + [np.inf] * dims])
    origins, aims = rng.uniform(-500, 1500, (60, dims)), rng.normal(size=(60, dims))
    rays = [[*o, *d, t] for o, d, t in zip(origins, aims, rng.choice([5.0, 900.0, 1e9, math.inf], 60))]
    along = [1.0] + [0.0] * (dims - 1)
    rays += [[*([0.0] * dims), *([1.0] * dims), math.inf], [*([900.0] * dims), *([-1.0] * dims), 2000.0]]  # the diagonal, both ways
    rays += [[-5.0, *low[0, 1:], *along, math.inf], [*low[1], *([0.0] * dims), math.inf], [*low[2], *([0.0] * dims), 3.0]]
    rays += [[1e7, *low[3, 1:], *(-1e-9 * np.array(along)), math.inf], [0.0] * dims + [1e-12] + [1.0] * (dims - 1) + [1e5], [-1e12] * dims + [1.0] * dims + [math.inf]]
    made, own = box_table(spark, boxes, dims), ray_table(spark, rays, dims)
    want = all_with_all(own, made, dims)
    assert len(want) > 60  # the diagonal alone has as many
    assert sorted(tuple(r) for r in joins.ray_join(own, made, dims).collect()) == want
    assert joins.ray_join(own, made.limit(0), dims).collect() == [] and joins.ray_join(own.limit(0), made, dims).collect() == []


def test_long_rays_meet_few_windows(spark):
    """A diagonal ray's windows overlap the boxes near it, not those of the whole extent."""
    rng = np.random.default_rng(9)
    low = rng.uniform(0, 1000, (3000, 2))
    made = box_table(spark, np.hstack([low, low + 1]), 2)
    own = ray_table(spark, [[0, 0, 1, 1, math.inf]], 2).withColumns({"min_x": F.lit(0.0), "min_y": F.lit(0.0), "max_x": F.lit(1001.0), "max_y": F.lit(1001.0)})
    windows = joins._along_rays(own, made, 2, [0.0, 0.0, 1001.0, 1001.0])
    assert windows.count() <= joins.RAY_PIECES + 2
    pieces = windows.select(F.col("ray_id").alias("item_id"), *box_names(2))
    assert 0 < joins.overlap_join(pieces, made).count() < 3000 * 3 / joins.RAY_PIECES
