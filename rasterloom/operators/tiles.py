"""Tile-parallel neighbourhood work: one shuffle by tile, array arithmetic inside.

Pixels are unique, so a tile with its halo holds at most (tile + 2 halo)^2 rows
whatever the size of the raster: groups are bounded by geometry, not by data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

TILE = 256


def halo_tiles(axis: Column, tile: int, halo: int) -> Column:
    """Tile numbers along one axis whose halo-extended span holds ``axis``."""
    first = F.greatest(F.floor((axis - halo) / tile), F.lit(0)).cast("int")
    last = F.floor((axis + halo) / tile).cast("int")
    return F.sequence(first, last)


def explode_tiles(df: DataFrame, tile: int = TILE, halo: int = 0) -> DataFrame:
    """Copy each pixel to the 1..4 tiles that need it; adds tile_y, tile_x."""
    if halo == 0:
        return (df.withColumn("tile_y", F.floor(F.col("row") / tile).cast("int"))
                .withColumn("tile_x", F.floor(F.col("col") / tile).cast("int")))
    return (df.withColumn("tile_y", F.explode(halo_tiles(F.col("row"), tile, halo)))
            .withColumn("tile_x", F.explode(halo_tiles(F.col("col"), tile, halo))))


def map_tiles(df: DataFrame, fn: Callable[[pd.DataFrame, int, int], pd.DataFrame],
              schema: str, tile: int = TILE, halo: int = 0) -> DataFrame:
    """Run ``fn(pixels, row0, col0)`` per tile; row0/col0 are the core's first cell."""

    return run_tiles(explode_tiles(df, tile, halo), fn, schema, tile)


def run_tiles(exploded: DataFrame, fn: Callable[[pd.DataFrame, int, int], pd.DataFrame],
              schema: str, tile: int) -> DataFrame:
    """``map_tiles`` for rows that already carry tile_y and tile_x."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf, int(key[0]) * tile, int(key[1]) * tile)

    return exploded.groupBy("tile_y", "tile_x").applyInPandas(run, schema)


# --- array helpers used inside tasks ------------------------------------------------

def slide(a: np.ndarray, width: int, axis: int, op: Callable) -> np.ndarray:
    """Reduce every run of ``width`` cells along ``axis`` by doubling (valid mode)."""
    a = np.moveaxis(a, axis, 0)
    size = 1
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    if width > size:
        rest = width - size
        a = op(a[:-rest], a[rest:])
    return np.moveaxis(a, 0, axis)


def box_max(a: np.ndarray, r: int, fill) -> np.ndarray:
    """Maximum over the (2r+1) square around each cell, same shape."""
    padded = np.pad(a, r, constant_values=fill)
    return slide(slide(padded, 2 * r + 1, 0, np.maximum), 2 * r + 1, 1, np.maximum)


def box_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sum over the (2r+1) square around each cell, zeros outside, same shape."""
    padded = np.pad(a, ((r + 1, r), (r + 1, r))).cumsum(0).cumsum(1)
    w = 2 * r + 1
    return padded[w:, w:] - padded[:-w, w:] - padded[w:, :-w] + padded[:-w, :-w]


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """``out[y, x] = a[y + dy, x + dx]``, ``fill`` beyond the edge."""
    out = np.full_like(a, fill)
    h, w = a.shape
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    out[ys, xs] = a[max(0, dy):max(0, dy) + ys.stop - ys.start,
                    max(0, dx):max(0, dx) + xs.stop - xs.start]
    return out


def focal(df: DataFrame, value: str, *, how: str, name: str,
          offsets: Sequence[tuple[int, int, float]] | None = None,
          box: int | None = None, tile: int = TILE, dense: tuple[int, int] | None = None,
          ) -> DataFrame:
    """Neighbourhood reduction of one numeric column at every pixel.

    how      sum, max, min (NULL/absent cells count as 0 for sum, are ignored by
             max and min), or maxw: max of value * weight, or dist: smallest
             weight among neighbours whose value is positive
    offsets  (dy, dx, weight) list; box=r is the (2r+1) square, done separably
    dense    (height, width): also return cells absent from ``df``
    Pixels must be unique.  Result: row, col, ``name`` (NULL when nothing is near).
    """
    halo = box if box is not None else max(max(abs(o[0]), abs(o[1])) for o in offsets)
    fills = {"sum": 0.0, "max": -np.inf, "maxw": -np.inf, "min": np.inf, "dist": np.inf}
    if how not in fills:
        raise ValueError(f"unknown reduction {how!r}")
    fill = fills[how]

    def reduce_tile(pdf: pd.DataFrame, row0: int, col0: int) -> pd.DataFrame:
        side = tile + 2 * halo
        y = pdf["row"].to_numpy() - (row0 - halo)
        x = pdf["col"].to_numpy() - (col0 - halo)
        v = pdf["v"].to_numpy(dtype=float, na_value=np.nan)
        a = np.full((side, side), fill)
        keep = ~np.isnan(v)
        if how == "dist":
            keep &= v > 0
            v = np.zeros_like(v)
        a[y[keep], x[keep]] = v[keep]
        if box is not None and how == "sum":
            out = box_sum(a, box)
        elif box is not None and how == "max":
            out = box_max(a, box, fill)
        elif box is not None and how == "min":
            out = -box_max(-a, box, -fill)
        else:
            out = np.full_like(a, fill)
            for dy, dx, w in offsets:
                near = shifted(a, dy, dx, fill)
                if how == "sum":
                    out += near
                elif how == "min":
                    np.minimum(out, near, out=out)
                elif how == "dist":
                    np.minimum(out, near + w, out=out)
                else:
                    np.maximum(out, near * w if how == "maxw" else near, out=out)
        if dense is not None:
            gy, gx = np.mgrid[row0:min(row0 + tile, dense[0]), col0:min(col0 + tile, dense[1])]
            rows, cols = gy.ravel(), gx.ravel()
        else:
            core = ((y >= halo) & (y < halo + tile) & (x >= halo) & (x < halo + tile))
            rows, cols = pdf["row"].to_numpy()[core], pdf["col"].to_numpy()[core]
        got = out[rows - row0 + halo, cols - col0 + halo]
        got = pd.Series(got).astype("float64")
        got[~np.isfinite(got)] = np.nan
        return pd.DataFrame({"row": rows.astype("int32"), "col": cols.astype("int32"), name: got})

    cells = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                      F.col(value).cast("double").alias("v"))
    if dense is not None:
        # One empty marker per tile makes tiles without pixels appear in the result.
        tiles_y, tiles_x = -(-dense[0] // tile), -(-dense[1] // tile)
        marks = (df.sparkSession.range(tiles_y * tiles_x)
                 .select((F.floor(F.col("id") / tiles_x) * tile).cast("int").alias("row"),
                         (F.col("id") % tiles_x * tile).cast("int").alias("col"),
                         F.lit(None).cast("double").alias("v")))
        cells = cells.unionByName(marks)
    out = map_tiles(cells, reduce_tile, f"row int, col int, {name} double", tile, halo)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def box_statistics(df: DataFrame, values: Sequence[str], box: int, tile: int = TILE) -> DataFrame:
    """row, col and low, high, total of the (2*box+1) square per column: ``<value>_low`` and so on.

    All columns and reductions take one tile shuffle.  Absent cells are ignored by low and high
    (NULL when nothing is near) and count 0 in the total.
    """
    values = list(values)

    def run(pdf: pd.DataFrame, row0: int, col0: int) -> pd.DataFrame:
        side = tile + 2 * box
        y, x = pdf["row"].to_numpy() - (row0 - box), pdf["col"].to_numpy() - (col0 - box)
        core = (y >= box) & (y < box + tile) & (x >= box) & (x < box + tile)
        out = {"row": pdf["row"].to_numpy()[core], "col": pdf["col"].to_numpy()[core]}
        for v in values:
            a = np.full((side, side), np.nan)
            a[y, x] = pdf[v].to_numpy(dtype=float, na_value=np.nan)
            there = ~np.isnan(a)
            low = -box_max(np.where(there, -a, -np.inf), box, -np.inf)
            high = box_max(np.where(there, a, -np.inf), box, -np.inf)
            # Plain sums of the few cells: differences of running sums would lose the last digits.
            filled = np.where(there, a, 0.0)
            down = sum(shifted(filled, d, 0, 0.0) for d in range(-box, box + 1))
            total = sum(shifted(down, 0, d, 0.0) for d in range(-box, box + 1))
            for name, found in (("low", low), ("high", high), ("total", total)):
                got = pd.Series(found[y[core], x[core]], dtype="float64")
                out[f"{v}_{name}"] = got.where(np.isfinite(got), np.nan).to_numpy()
        return pd.DataFrame(out)

    cells = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                      *[F.col(v).cast("double").alias(v) for v in values])
    names = [f"{v}_{n}" for v in values for n in ("low", "high", "total")]
    out = map_tiles(cells, run, "row int, col int, " + ", ".join(f"`{n}` double" for n in names), tile, box)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names if not n.endswith("_total")})


def ring_distance(df: DataFrame, flag: str, reach: int, name: str, tile: int = TILE) -> DataFrame:
    """Chebyshev distance to the nearest flagged pixel up to ``reach``, else NULL."""

    def run(pdf: pd.DataFrame, row0: int, col0: int) -> pd.DataFrame:
        side = tile + 2 * reach
        y, x = pdf["row"].to_numpy() - (row0 - reach), pdf["col"].to_numpy() - (col0 - reach)
        grown = np.zeros((side, side), dtype=bool)
        on = pdf["v"].to_numpy() > 0
        grown[y[on], x[on]] = True
        dist = np.where(grown, 0, -1)
        for r in range(1, reach + 1):
            grown = box_max(grown, 1, False)
            dist[grown & (dist < 0)] = r
        core = (y >= reach) & (y < reach + tile) & (x >= reach) & (x < reach + tile)
        got = pd.array(dist[y[core], x[core]], dtype="Int32")
        got[got < 0] = pd.NA
        return pd.DataFrame({"row": pdf["row"].to_numpy()[core], "col": pdf["col"].to_numpy()[core], name: got})

    cells = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                      F.coalesce(F.col(flag).cast("int"), F.lit(0)).alias("v"))
    return map_tiles(cells, run, f"row int, col int, {name} int", tile, reach)


# --- overlapping tiles and user-supplied scorers -----------------------------------

def overlap_tiles(axis: Column, size: int, core: int, step: int, halo: int) -> Column:
    """Tile numbers whose halo-extended core [step*i, step*i + core) holds ``axis``."""
    count = -(-size // step)
    first = F.greatest(F.ceil((axis - (core + halo - 1)) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((axis + halo) / step), F.lit(count - 1)).cast("int")
    return F.sequence(first, last)


def within(axis: Column, size: int) -> Column:
    """``axis`` itself; fails the job where it is outside [0, size)."""
    return F.when((axis >= 0) & (axis < size), axis).otherwise(
        F.raise_error(F.lit(f"pixel outside the raster's {size} cells")).cast("int"))


def halo_tiling(df: DataFrame, height: int, width: int, core: int = 256, step: int = 224,
                halo: int = 15) -> DataFrame:
    """Assign each pixel to every tile that reads it; ``in_core`` marks owned pixels.

    ``step=core`` gives non-overlapping cores.  Fails the job on a pixel outside the shape.
    """
    row, col = within(F.col("row"), height), within(F.col("col"), width)
    out = (df.withColumn("tile_y", F.explode(overlap_tiles(row, height, core, step, halo)))
           .withColumn("tile_x", F.explode(overlap_tiles(col, width, core, step, halo))))
    inside = [(F.col(a) >= F.col(t) * step) & (F.col(a) < F.col(t) * step + core)
              for a, t in (("row", "tile_y"), ("col", "tile_x"))]
    return out.withColumn("in_core", inside[0] & inside[1])


def edge_padded(df: DataFrame, centres: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Neighbour lookup with edge replication: outside cells read the nearest border cell.

    One row per centre and offset: c_row, c_col, dy, dx and the columns of ``df``.
    Fails the job on a pixel or centre outside the shape.
    """
    df = df.withColumns({"row": within(F.col("row"), height), "col": within(F.col("col"), width)})
    centres = centres.select(within(F.col("row"), height).alias("row"), within(F.col("col"), width).alias("col"))
    span = F.array(*[F.lit(d) for d in range(-radius, radius + 1)])
    want = (centres.select(F.col("row").alias("c_row"), F.col("col").alias("c_col"))
            .withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))
            .withColumn("row", F.least(F.greatest(F.col("c_row") + F.col("dy"), F.lit(0)),
                                       F.lit(height - 1)))
            .withColumn("col", F.least(F.greatest(F.col("c_col") + F.col("dx"), F.lit(0)),
                                       F.lit(width - 1))))
    return want.join(df, ["row", "col"])


def score_tiles(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], height: int,
                width: int, *, columns: Sequence[str], core: int = 256, step: int = 224,
                halo: int = 15, mask: str | None = None) -> DataFrame:
    """Score every tile with ``scorer`` and average the overlapping cores.

    ``scorer`` sees the pixels of one tile (row, col and ``columns``) and returns
    row, col, p.  Cells outside ``mask`` give 0; results are clipped to [0, 1].
    """
    keep = [*columns] + ([mask] if mask and mask not in columns else [])
    tiled = halo_tiling(df.select("row", "col", *keep), height, width, core, step, halo)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = scorer(pdf[["row", "col", *columns]])[["row", "col", "p"]]
        y0, x0 = int(key[0]) * step, int(key[1]) * step
        own = ((out["row"] >= y0) & (out["row"] < y0 + core)
               & (out["col"] >= x0) & (out["col"] < x0 + core))
        return out[own].astype({"row": "int32", "col": "int32", "p": "float64"})

    scored = tiled.groupBy("tile_y", "tile_x").applyInPandas(run, "row int, col int, p double")
    averaged = overlap_average(scored)
    if mask:
        averaged = (df.select("row", "col", mask).join(averaged, ["row", "col"], "left")
                    .select("row", "col",
                            F.when(F.col(mask), F.coalesce("p", F.lit(0.0))).otherwise(0.0).alias("p")))
    return averaged.withColumn("p", F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)))


def overlap_average(scored: DataFrame) -> DataFrame:
    """Mean of the overlapping tile results per pixel."""
    return scored.groupBy("row", "col").agg(F.avg("p").alias("p"))


def patches(df: DataFrame, centres: DataFrame, radius: int, columns: Sequence[str],
            on_border: str = "raise", shape: tuple[int, int] | None = None) -> DataFrame:
    """Square patches: row, col and per column an array of (2r+1)^2 values, row-major.

    Pixels are shuffled once by tile and patches are cut from the tile's arrays, so
    the (2r+1)^2-fold copy exists only in the result.
    on_border "skip" drops patches with an absent cell, "raise" fails the job on one;
    "edge" first repeats the border cells of the raster of ``shape`` (height, width)
    outwards and then skips patches that still lack a cell.
    """
    if on_border not in ("raise", "skip", "edge") or (on_border == "edge") != (shape is not None):
        raise ValueError("on_border is 'raise', 'skip', or 'edge' with a shape")
    columns = list(columns)
    width = 2 * radius + 1
    # Even if every pixel is a centre, a tile's patches stay near 128 MB.
    tile = min(max(int((16e6 / (width**2 * len(columns))) ** 0.5), 16), 128)
    side = tile + 2 * radius

    def cut(pdf: pd.DataFrame, row0: int, col0: int) -> pd.DataFrame:
        y, x = pdf["row"].to_numpy() - (row0 - radius), pdf["col"].to_numpy() - (col0 - radius)
        cell = ~pdf["is_centre"].to_numpy()
        source = np.arange(side)
        gy = gx = source
        if shape is not None:
            gy = np.clip(source + row0 - radius, 0, shape[0] - 1) - (row0 - radius)
            gx = np.clip(source + col0 - radius, 0, shape[1] - 1) - (col0 - radius)
        there = np.zeros((side, side), dtype=bool)
        there[y[cell], x[cell]] = True
        there = there[np.ix_(gy, gx)]
        cy, cx = y[~cell], x[~cell]
        if not len(cy):
            return pd.DataFrame({"row": cy.astype("int32"), "col": cx.astype("int32"),
                                 **{c: pd.Series([], dtype=object) for c in columns}})
        windows = np.lib.stride_tricks.sliding_window_view
        whole = windows(there, (width, width))[cy - radius, cx - radius].all(axis=(1, 2))
        if on_border == "raise" and not whole.all():
            bad = int(np.argmin(whole))
            raise ValueError(f"incomplete patch at ({cy[bad] + row0 - radius}, {cx[bad] + col0 - radius})")
        cy, cx = cy[whole], cx[whole]
        out = {"row": (cy + row0 - radius).astype("int32"), "col": (cx + col0 - radius).astype("int32")}
        for c in columns:
            a = np.full((side, side), np.nan)
            a[y[cell], x[cell]] = pdf[c].to_numpy(dtype=float, na_value=np.nan)[cell]
            cut_out = windows(a[np.ix_(gy, gx)], (width, width))[cy - radius, cx - radius].reshape(len(cy), width * width)
            out[c] = pd.Series(list(cut_out), dtype=object)
        return pd.DataFrame(out)

    cells = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                      *[F.col(c).cast("double").alias(c) for c in columns], F.lit(False).alias("is_centre"))
    marks = centres.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                           *[F.lit(None).cast("double").alias(c) for c in columns], F.lit(True).alias("is_centre"))
    both = explode_tiles(cells, tile, radius).unionByName(explode_tiles(marks, tile))
    schema = "row int, col int, " + ", ".join(f"`{c}` array<double>" for c in columns)
    return run_tiles(both, cut, schema, tile)


def score_patches(patch_df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Score patches batch by batch: ``scorer`` maps a frame of patches to one p each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"row": pdf["row"], "col": pdf["col"],
                                "p": np.asarray(scorer(pdf), dtype="float64")})

    return patch_df.mapInPandas(run, "row int, col int, p double")


def centre_mean(patch_df: DataFrame, column: str, radius: int, half: int = 2) -> DataFrame:
    """Mean of ``column`` over the central (2*half+1)^2 cells of each patch."""
    width = 2 * radius + 1
    inner = F.filter(column, lambda v, i: (F.abs(F.floor(i / width) - radius) <= half)
                     & (F.abs(i % width - radius) <= half))
    total = F.aggregate(inner, F.lit(0.0), lambda acc, v: acc + v)
    return patch_df.select("row", "col", (total / F.size(inner)).alias("centre_mean"))
