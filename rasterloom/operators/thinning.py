"""Greedy spatial thinning of scored pixels, computed in tile-parallel rounds.

Visiting pixels best-first and skipping any whose (2r+1) window touches an
occupied cell selects the lexicographically first maximal independent set of the
graph that joins pixels at Chebyshev distance <= 2r.  A tile settles everything
that does not hinge on an undecided pixel of a neighbour tile; that residue goes to
the next round.  Once a round leaves over half of it, it is not stored again: later
rounds run only the tiles that new picks of other tiles can have changed and store
nothing but their picks, from which every tile works out which pixels are still open.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint
from .ordering import best_first, few, global_rank, prefix_bound, top_k
from .tiles import TILE, box_max, explode_tiles, run_tiles

_STATES = "row int, col int, p double, state int"


def _settle(tile: int, reach: int, halo: int, leave_open: bool):
    """Tile function: state 0 = undecided, 1 = picked; undecided pixels come back if ``leave_open``.

    ``halo`` is the width of the border that the given pixels may fill.
    """

    def run(pdf: pd.DataFrame, row0: int, col0: int) -> pd.DataFrame:
        y = pdf["row"].to_numpy() - (row0 - halo)
        x = pdf["col"].to_numpy() - (col0 - halo)
        core = (y >= halo) & (y < halo + tile) & (x >= halo) & (x < halo + tile)
        state = pdf["state"].to_numpy()
        waiting = state == 0
        if not (core & waiting).any():
            return pdf.iloc[:0][["row", "col", "p", "state"]]
        side = tile + 2 * halo
        # Dense in-tile ranks realise the (p, row, col) order as one integer; 0 = nothing.
        order = np.lexsort((pdf["col"].to_numpy(), pdf["row"].to_numpy(), pdf["p"].to_numpy()))
        rank = np.empty(len(pdf), dtype=np.int64)
        rank[order] = np.arange(1, len(pdf) + 1)
        live = np.zeros((side, side), dtype=np.int64)
        live[y[waiting], x[waiting]] = rank[waiting]
        mine = np.zeros((side, side), dtype=bool)
        mine[halo:halo + tile, halo:halo + tile] = True
        picked = np.zeros((side, side), dtype=bool)
        fresh = np.zeros((side, side), dtype=bool)
        fresh[y[~waiting], x[~waiting]] = True
        while True:
            if fresh.any():
                live[box_max(fresh, reach, False)] = 0
            fresh = mine & (live > 0) & (live == box_max(live, reach, 0))
            if not fresh.any():
                break
            picked |= fresh
        now = np.where(picked[y, x], 1, 0)
        keep = core & waiting & (picked[y, x] | (leave_open & (live[y, x] > 0)))
        out = pdf.loc[keep, ["row", "col", "p"]].copy()
        out["state"] = now[keep].astype("int32")
        return out

    return run


def thin(scored: DataFrame, radius: int, k: int | None = None, *, ranked: bool = True,
         tile: int | None = None, stored: bool = False) -> DataFrame:
    """Thin unique pixels (row, col, p); columns row, col, p and ``thin_rank``.

    With ``k`` only the first k picks stay.  A pick removes at most (4r+1)^2 - 1
    others, so the best k*(4r+1)^2 pixels always contain the first k picks: the
    rest is filtered before any shuffle and the result is still exact.  That takes
    three passes over ``scored``, which is stored first unless it is ``stored`` already.
    Pixels without a score are never picked and stand in nobody's way.
    """
    if radius < 0:
        raise ValueError("radius must not be negative")
    if k is not None and k <= 0:
        raise ValueError("k must be positive")
    pixels = scored.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                           F.col("p").cast("double").alias("p")).filter("p is not null")
    if k is not None and not stored:
        pixels = checkpoint(pixels)
    if radius == 0:
        picks = pixels
    else:
        if k is not None:
            bound = prefix_bound(pixels, "p", k * (4 * radius + 1) ** 2)
            if bound is not None:
                pixels = pixels.filter(F.col("p") >= F.lit(bound))
        reach = 2 * radius
        tile = tile or max(TILE, 4 * reach)
        picks = _worklist(pixels, reach, tile)
    if k is not None:
        return top_k(picks, k, best_first(), rank="thin_rank" if ranked else None, lead="p")
    return global_rank(picks, best_first(), "thin_rank") if ranked else picks


def _worklist(pixels: DataFrame, reach: int, tile: int) -> DataFrame:
    """All picks of ``pixels`` whose windows reach ``reach`` cells.

    While a round leaves at most half of the undecided pixels it got, they are stored anew,
    which is twice the first store in all.  From the first round that leaves more, which
    long slopes do, they stay as they are and only changed tiles run.  There, an
    undecided pixel up to ``reach`` outside a tile may be covered by a pick another
    ``reach`` away, so picks travel twice as far as undecided pixels.  A tile that no
    new pick of another tile lies so close to sees what it saw before and rests.
    """
    todo = pixels.withColumn("state", F.lit(0))
    found: list[DataFrame] = []
    before = None
    while True:
        after = checkpoint(run_tiles(explode_tiles(todo, tile, reach), _settle(tile, reach, reach, True), _STATES, tile))
        open_, fresh = after.filter("state = 0"), after.filter("state = 1")
        found.append(fresh)
        n, picked = after.agg(F.count(F.when(F.col("state") == 0, 1)), F.count(F.when(F.col("state") == 1, 1))).first()
        if n == 0:
            return reduce(DataFrame.unionByName, found).drop("state")
        # More than all windows of the round's picks could hold is more than half of what it got.
        if n > picked * (2 * reach + 1) ** 2 or before is not None and 2 * n > before:
            break
        before = n
        # A pick has already cleared its own tile; only those within reach of a
        # tile edge can matter to a neighbour.
        edge = [(F.pmod(F.col(a), F.lit(tile)) < reach)
                | (F.pmod(F.col(a), F.lit(tile)) >= tile - reach) for a in ("row", "col")]
        todo = open_.unionByName(fresh.filter(edge[0] | edge[1]))
    waiting = explode_tiles(open_, tile, reach)
    settle = _settle(tile, reach, 2 * reach, False)
    own = ((F.col("tile_y") == F.floor(F.col("row") / tile)) & (F.col("tile_x") == F.floor(F.col("col") / tile)))
    while True:
        changed = explode_tiles(fresh, tile, 2 * reach).filter(~own).select("tile_y", "tile_x").distinct()
        n = changed.count()      # reads the picks of one round
        if n == 0:
            break
        seen = waiting.unionByName(explode_tiles(reduce(DataFrame.unionByName, found), tile, 2 * reach))
        work = seen.join(few(changed, n), ["tile_y", "tile_x"], "left_semi")
        fresh = checkpoint(run_tiles(work, settle, _STATES, tile))
        found.append(fresh)
    return reduce(DataFrame.unionByName, found).drop("state")


def cut_then_thin(scored: DataFrame, radius: int, k: int) -> DataFrame:
    """Variant: cut to the best k first, then thin, so fewer than k may remain."""
    return thin(top_k(scored.select("row", "col", "p"), k, best_first(), lead="p"), radius)
