"""Exact distance to the nearest truth pixel in time linear in the pixels.

The raster is cut into strips of whole rows.  Per strip and column only the first and last truth
row are shuffled; running maxima over the strips then give, for each column of each strip, the
nearest truth row above and below it.  With these carried pixels a strip knows
the vertical distance of each of its cells, and the lower envelope of the parabolas that they span
along a row gives the squared distance of every cell of that row, all rows of a strip in lockstep.
How far the truth is, or how crowded, changes no step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

CELLS = 1 << 21         # cells of a strip
_LEAST_ROWS = 16        # rows of a strip however wide the raster is
_FAR = 1 << 29          # vertical distance of a column without truth


def envelope(squares: np.ndarray) -> np.ndarray:
    """min over x' of (x - x')^2 + squares[:, x'] for each x of each row."""
    n, width = squares.shape
    lanes = np.arange(n)
    top = np.zeros(n, np.int64)                     # last parabola of each row's envelope
    place = np.zeros((n, width), np.int32)          # where it stands
    since = np.zeros((n, width), np.int32)          # the cell from which on it is the lowest
    for u in range(1, width):
        live = lanes
        while len(live):
            at = top[live]
            x, v = since[live, at].astype(np.int64), place[live, at].astype(np.int64)
            live = live[(x - v) ** 2 + squares[live, v] > (x - u) ** 2 + squares[live, u]]
            top[live] -= 1
            live = live[top[live] >= 0]
        none = top < 0
        top[none], place[none, 0] = 0, u
        some = lanes[~none]
        v = place[some, top[some]].astype(np.int64)
        start = 1 + (u * u - v * v + squares[some, u] - squares[some, v]) // (2 * (u - v))
        some, start = some[start < width], start[start < width]
        top[some] += 1
        place[some, top[some]], since[some, top[some]] = u, start
    out = np.empty_like(squares)
    for u in range(width - 1, -1, -1):
        v = place[lanes, top].astype(np.int64)
        out[:, u] = (u - v) ** 2 + squares[lanes, v]
        top -= since[lanes, top] == u
        np.maximum(top, 0, out=top)
    return out


def nearest_truth(points: DataFrame, truth: DataFrame, res: float = 100.0, cells: int = CELLS) -> DataFrame:
    """row, col, distance_px, distance_m of each distinct point pixel; +inf without truth."""
    def pixels(df: DataFrame) -> DataFrame:
        return df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()

    p, t = pixels(points), pixels(truth)
    edges = [f(c) for c in ("row", "col") for f in (F.min, F.max)]
    a, b = p.agg(*edges).first(), t.agg(*edges).first()
    if a[0] is None or b[0] is None:
        none = F.lit(float("inf"))
        return p.select("row", "col", none.alias("distance_px"), none.alias("distance_m"))
    upper, left, right = min(a[0], b[0]), min(a[2], b[2]), max(a[3], b[3])
    width = right - left + 1
    height = max(cells // width, _LEAST_ROWS)
    strip = F.floor((F.col("row") - upper) / height).cast("long").alias("strip")

    p, t = p.select(strip, "row", "col"), t.select(strip, "row", "col")
    borders = t.groupBy("strip", "col").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.lit(False).alias("asked"))
    nothing = F.lit(None).cast("int")
    asked = (p.select("strip").distinct().withColumn("col", F.explode(F.sequence(F.lit(left), F.lit(right))))
             .select("strip", "col", nothing.alias("first"), nothing.alias("last"), F.lit(True).alias("asked")))
    column = Window.partitionBy("col")
    earlier = column.orderBy(F.col("strip").asc()).rangeBetween(Window.unboundedPreceding, -1)
    later = column.orderBy(F.col("strip").desc()).rangeBetween(Window.unboundedPreceding, -1)
    carried = (asked.unionByName(borders).select("strip", "col", "asked", F.max("last").over(earlier).alias("above"),
                                                 F.min("first").over(later).alias("below"))
               .filter("asked").select("strip", "col", F.explode(F.array("above", "below")).alias("row")).filter("row is not null"))
    rows = (p.withColumn("kind", F.lit(0)).unionByName(t.withColumn("kind", F.lit(1)))
            .unionByName(carried.select("strip", "row", "col", F.lit(1).alias("kind"))))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        first = upper + key[0].as_py() * height
        row, col, kind = (group.column(c).to_numpy().astype(np.int64) for c in ("row", "col", "kind"))
        y, x, is_truth = row - first, col - left, kind == 1
        if is_truth.all():
            return pa.table({"row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), "d2": pa.array([], pa.int64())})
        wanted, lane = np.unique(y[~is_truth], return_inverse=True)
        above = np.full((height, width), -_FAR, np.int64)
        below = np.full((height, width), _FAR, np.int64)
        ty, tx = y[is_truth], x[is_truth]
        low, high = ty < height, ty >= 0
        np.maximum.at(above, (np.maximum(ty[low], 0), tx[low]), ty[low])
        np.minimum.at(below, (np.minimum(ty[high], height - 1), tx[high]), ty[high])
        above = np.maximum.accumulate(above, axis=0)[wanted]
        below = np.minimum.accumulate(below[::-1], axis=0)[::-1][wanted]
        vertical = np.minimum(np.minimum(wanted[:, None] - above, below - wanted[:, None]), _FAR)
        found = envelope(vertical ** 2)[lane, x[~is_truth]]
        return pa.table({"row": pa.array(row[~is_truth].astype(np.int32)), "col": pa.array(col[~is_truth].astype(np.int32)),
                         "d2": pa.array(found)})

    px = F.sqrt(F.col("d2").cast("double"))
    return (rows.groupBy("strip").applyInArrow(run, "row int, col int, d2 long")
            .select("row", "col", px.alias("distance_px"), (px * res).alias("distance_m")))
