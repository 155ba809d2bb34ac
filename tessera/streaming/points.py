"""Streams of points against a static set of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import AXES, all_of, box_columns, box_names
from tessera.operators.joins import cell_side

#: Cells that one box may cover in the stream's lookup table.
MOST_CELLS_EACH = 4096


def locate_stream(points: DataFrame, boxes: DataFrame, dims: int = 2, item_id: str = "item_id") -> DataFrame:
    """Each event of a stream (x, y, [z] and any others) with the id of every box
    that holds it. The boxes are cut into grid cells once; each event looks up
    its one cell by an equi-join, which is stateless: late events need no
    watermark."""
    axes = AXES[:dims]
    own = box_columns(dims)
    side, _ = cell_side([boxes], dims)
    widest = boxes.agg(*[F.max(hi - lo) for lo, hi in zip(own.low, own.high)]).first()
    spread = max([v for v in widest if v is not None], default=0.0)
    side = max(side, spread / MOST_CELLS_EACH ** (1 / dims))
    cells = boxes.select(F.col(item_id).alias("box_id"), *box_names(dims))
    for axis, lo, hi in zip(axes, own.low, own.high):
        cells = cells.withColumn(f"cell_{axis}", F.explode(F.sequence(F.floor(lo / side), F.floor(hi / side))))
    keyed = points.withColumns({f"cell_{a}": F.floor(F.col(a) / side) for a in axes})
    inside = all_of([(F.col(a) >= lo) & (F.col(a) <= hi) for a, lo, hi in zip(axes, own.low, own.high)])
    met = keyed.join(cells, [f"cell_{a}" for a in axes]).filter(inside)
    return met.select(*points.columns, "box_id")


def windowed_counts(located: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events for each box and tumbling window, with a watermark for late data."""
    return (
        located.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), "box_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), "box_id", "events")
    )
