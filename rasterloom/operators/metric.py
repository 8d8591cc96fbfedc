"""Distance-weighted Tversky index (DTI) and its relatives, as joins and sums.

    k(d) = max(1 - d/R, 0)
    TP   = sum over truth of the largest p * k within R
    FN   = sum over truth of 1 - that value
    FP   = sum over predictions of p * (1 - largest k to a truth pixel)
    DTI  = TP / (TP + alpha FP + beta FN + eps)
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kernels import box, disc, linear_kernel, offset_array, weighted_disc

ALPHA, BETA, RADIUS, EPS = 0.2, 0.8, 3, 1e-12   # fixed values of the metric


def spread_truth(truth: DataFrame, offsets: Sequence[tuple[int, int, float]],
                 by: Sequence[str] = ()) -> DataFrame:
    """Every truth pixel once per offset: by..., row, col (reached), t_row, t_col, w.

    Only the sparse truth side is multiplied (25 offsets for R = 3), never the
    predictions.  Spark guesses its size without that factor, so the merge hint keeps
    joins from broadcasting it; aggregates pass the hint on.
    """
    return (truth.select(*by, F.col("row").alias("t_row"), F.col("col").alias("t_col"),
                         F.explode(offset_array(list(offsets))).alias("o"))
            .select(*by, (F.col("t_row") + F.col("o.dy")).alias("row"),
                    (F.col("t_col") + F.col("o.dx")).alias("col"),
                    "t_row", "t_col", F.col("o.w").alias("w")).hint("merge"))


def truth_reach(truth: DataFrame, offsets: Sequence[tuple[int, int, float]],
                by: Sequence[str] = ()) -> DataFrame:
    """Largest offset weight from any truth pixel: by..., row, col, influence."""
    return spread_truth(truth, offsets, by).groupBy(*by, "row", "col").agg(F.max("w").alias("influence"))


def influence(truth: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Largest kernel weight from any truth pixel: row, col, influence."""
    return truth_reach(truth, weighted_disc(radius, linear_kernel(radius)))


def _spans(df: DataFrame, tile: int, halo: int) -> DataFrame:
    """Each pixel once per tile whose halo-extended span holds it; coordinates may be negative."""
    for axis, name in (("row", "tile_y"), ("col", "tile_x")):
        first, last = (F.floor((F.col(axis) + d) / tile).cast("int") for d in (-halo, halo))
        df = df.withColumn(name, F.explode(F.sequence(first, last)))
    return df


def tile_sums(pred: DataFrame, truth: DataFrame, match: Sequence[tuple[int, int, float]],
              reach: Sequence[tuple[int, int, float]], by: Sequence[str] = ()) -> DataFrame:
    """by..., tile_y, tile_x, tp, fp: one row per tile (and group) that holds a pixel with p.

    match   offsets and weights of a truth pixel's best prediction
    reach   offsets and weights of a prediction's nearest truth
    Both sides meet once by tile, so neither is multiplied by offsets, however wide they are.
    ``by`` takes few values, which all see the same truth: a task holds one tile of all of them.
    """
    by = list(by)
    halo = max(abs(d) for o in (*match, *reach) for d in o[:2])
    tile = max(128, 8 * halo)

    def run(key: tuple, pixels: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        row0, col0 = int(key[0]) * tile - halo, int(key[1]) * tile - halo
        on = np.zeros((tile + 2 * halo, tile + 2 * halo), dtype=bool)
        on[marks["row"].to_numpy() - row0, marks["col"].to_numpy() - col0] = True
        ty, tx = np.nonzero(on[halo:halo + tile, halo:halo + tile])
        y, x = pixels["row"].to_numpy() - row0 - halo, pixels["col"].to_numpy() - col0 - halo
        core = (y >= 0) & (y < tile) & (x >= 0) & (x < tile)
        # Only as much of the tile as its pixels fill.
        h, w = (int(a[core].max(initial=-1)) + 1 for a in (y, x))
        near = np.zeros((h, w))
        if h and len(marks):
            for dy, dx, weight in reach:
                seen = on[halo + dy:halo + dy + h, halo + dx:halo + dx + w]
                np.maximum(near, np.where(seen, weight, 0.0), out=near)
        p = pixels["p"].to_numpy(dtype=float, na_value=np.nan)
        out = []
        groups = pixels.groupby(by, dropna=False, sort=False).indices.items() if by and len(pixels) else [((), np.arange(len(p)))]
        for name, at in groups:
            mine = at[core[at]]
            fp = float((p[mine] * (1 - near[y[mine], x[mine]])).sum())
            a = np.zeros(on.shape)
            np.maximum.at(a, (y[at] + halo, x[at] + halo), p[at])
            best = np.zeros(len(ty))
            if len(ty) and len(at):
                for dy, dx, weight in match:
                    np.maximum(best, a[ty + halo + dy, tx + halo + dx] * weight, out=best)
            name = name if isinstance(name, tuple) else (name,)
            out.append((*name, int(key[0]), int(key[1]), float(best.sum()), fp))
        return pd.DataFrame(out, columns=[*by, "tile_y", "tile_x", "tp", "fp"])

    types = dict(pred.select(*by).dtypes) if by else {}
    schema = "".join(f"`{b}` {types[b]}, " for b in by) + "tile_y int, tile_x int, tp double, fp double"
    there = F.col("row").isNotNull() & F.col("col").isNotNull()
    at = [F.col(c).cast("int").alias(c) for c in ("row", "col")]
    # A missing score is no match and no false positive.
    hot = pred.filter(there).select(*by, *at, F.coalesce(F.col("p").cast("double"), F.lit(0.0)).alias("p"))
    left = _spans(hot, tile, halo).groupBy("tile_y", "tile_x")
    right = _spans(truth.filter(there).select(*at), tile, halo).groupBy("tile_y", "tile_x")
    return left.cogroup(right).applyInPandas(run, schema)


def match_sums(pred: DataFrame, truth: DataFrame, offsets: Sequence[tuple[int, int, float]],
               by: Sequence[str] = (), truth_by: Sequence[str] = (), with_fp: bool = True,
               reach: Sequence[tuple[int, int, float]] | None = None) -> DataFrame:
    """tp, fp, fn, n_truth per group of ``by`` (columns of ``pred``).

    pred      unique (by, row, col) with p; zeros may be left out
    truth     truth pixels (truth_by, row, col); ``truth_by`` is a subset of ``by``
              when each group has its own truth
    reach     offsets of the false positives' truth, where they are not ``offsets``
    With one truth for all, tiles are summed (``tile_sums``).  Where each group has its
    own, both sums join on (row, col), so a shuffled ``pred`` is exchanged once and
    reused; all aggregates are hash aggregates with partial sums.
    """
    by, truth_by = list(by), list(truth_by)
    if not truth_by:
        # With groups, zero scores stay in so that an all-zero group still counts its misses.
        hot = pred if by else pred.filter(F.col("p") > 0)
        sums = tile_sums(hot, truth, offsets, reach or offsets, by).groupBy(*by).agg(
            F.coalesce(F.sum("tp"), F.lit(0.0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0.0)).alias("fp"))
        sums = sums.withColumn("n_truth", truth.agg(F.count(F.lit(1)).alias("n")).scalar())
        return sums.select(*by, "tp", "fp", "n_truth", (F.col("n_truth") - F.col("tp")).alias("fn"))
    key = [*truth_by, "row", "col"]
    # The NULL tests make both joins see the same plan, so its exchange is reused.
    hot = pred.filter(F.col("row").isNotNull() & F.col("col").isNotNull())
    hot = hot.select(*by, "row", "col", F.col("p").cast("double").alias("p"))
    best = (spread_truth(truth, offsets, truth_by).join(hot, key)
            .groupBy(*by, "t_row", "t_col").agg(F.max(F.col("p") * F.col("w")).alias("best")))
    tp = best.groupBy(*by).agg(F.sum("best").alias("tp"))
    if with_fp:
        near = F.coalesce("influence", F.lit(0.0))
        fp = (hot.join(truth_reach(truth, reach or offsets, truth_by), key, "left").groupBy(*by)
              .agg(F.sum(F.col("p") * (1 - near)).alias("fp")))
    else:
        fp = hot.groupBy(*by).agg(F.lit(0.0).alias("fp"))
    counted = truth.groupBy(*truth_by).agg(F.count(F.lit(1)).alias("n_truth"))
    sums = fp.join(tp, by, "left").join(counted, truth_by, "full" if truth_by == by else "left")
    sums = sums.fillna(0, ["tp", "fp", "n_truth"])
    return sums.select(*by, "tp", "fp", "n_truth", (F.col("n_truth") - F.col("tp")).alias("fn"))


def tversky(tp: Column, fp: Column, fn: Column, alpha: float = ALPHA, beta: float = BETA,
            eps: float = EPS, smooth: float = 0.0) -> Column:
    """(TP + smooth) / (TP + alpha FP + beta FN + eps + smooth)."""
    return (tp + F.lit(smooth)) / (tp + F.lit(alpha) * fp + F.lit(beta) * fn + F.lit(eps + smooth))


def dti(pred: DataFrame, truth: DataFrame, by: Sequence[str] = (), *, radius: float = RADIUS,
        alpha: float = ALPHA, beta: float = BETA, eps: float = EPS,
        empty_truth: str = "zero", truth_by: Sequence[str] = ()) -> DataFrame:
    """Canonical score: by..., tp, fp, fn, n_truth, dti.

    empty_truth  "zero": 0 without truth (eps form); "loop": 1 if there is also no
                 prediction; "denominator": 1 when the denominator is <= 1e-12
                 (use with eps=0); "safe": 0 when the denominator is 0
    """
    sums = match_sums(pred, truth, weighted_disc(radius, linear_kernel(radius)), by, truth_by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    score = tversky(tp, fp, fn, alpha, beta, eps)
    denominator = tp + F.lit(alpha) * fp + F.lit(beta) * fn
    if empty_truth == "loop":
        score = F.when(F.col("n_truth") == 0, F.when(fp > 0, F.lit(0.0)).otherwise(F.lit(1.0))
                       ).otherwise(score)
    elif empty_truth == "denominator":
        score = F.when(denominator <= F.lit(1e-12), F.lit(1.0)).otherwise(
            tp / F.greatest(denominator, F.lit(1e-12)))
    elif empty_truth == "safe":
        score = F.when(denominator > 0, tp / F.greatest(denominator, F.lit(5e-324))).otherwise(F.lit(0.0))
    elif empty_truth != "zero":
        raise ValueError(f"unknown empty_truth {empty_truth!r}")
    return sums.withColumn("dti", score)


def dti_truth_only(pred: DataFrame, truth: DataFrame, radius: float = RADIUS,
                   alpha: float = ALPHA, beta: float = BETA, eps: float = 1e-8) -> DataFrame:
    """Variant with weight 1/(1+d): hits count only on truth, near misses are discounted."""
    near = truth_reach(truth, [(dy, dx, 1.0 / (1.0 + d)) for dy, dx, d in disc(radius)])
    marks = truth.select("row", "col", F.lit(True).alias("is_truth"))
    both = (pred.select("row", "col", "p").join(near, ["row", "col"], "left")
            .join(marks, ["row", "col"], "left"))
    hit = F.col("is_truth").isNotNull()
    sums = both.agg(
        F.coalesce(F.sum(F.when(hit, F.col("p"))), F.lit(0.0)).alias("tp"),
        F.coalesce(F.sum(F.when(~hit, F.col("p") * (1 - F.coalesce("influence", F.lit(0.0))))),
                   F.lit(0.0)).alias("fp"),
        F.coalesce(F.sum(F.when(hit, 1 - F.col("p"))), F.lit(0.0)).alias("fn"))
    return sums.withColumn("score", tversky(F.col("tp"), F.col("fp"), F.col("fn"), alpha, beta, eps))


def dti_box(pred: DataFrame, truth: DataFrame, radius: int = RADIUS, alpha: float = ALPHA,
            beta: float = BETA, eps: float = 1e-7) -> DataFrame:
    """Variant: best p in the square counts fully; FP weighs min(d/R, 1) by distance.

    Truth pixels themselves are never false positives (d = 0).
    """
    # The square decides the match, the Euclidean distance the FP weight.
    sums = match_sums(pred.filter(F.col("p") > 0), truth, [(dy, dx, 1.0) for dy, dx, _ in box(radius)],
                      reach=weighted_disc(radius, linear_kernel(radius)))
    return sums.withColumn("score", tversky(F.col("tp"), F.col("fp"), F.col("fn"), alpha, beta, eps))


def patch_dti(cells: DataFrame, patch: Sequence[str], size: int, radius: int = RADIUS,
              alpha: float = ALPHA, beta: float = BETA, eps: float = 1e-7) -> DataFrame:
    """DTI per patch with a ``radius`` margin cropped and invalid pixels masked.

    ``cells``: patch columns, row and col inside the patch, p, g, valid.  Matches may
    use margin pixels; only inner truth and inner predictions are counted.
    """
    patch = list(patch)
    inner = (F.col("row").between(radius, size - radius - 1)
             & F.col("col").between(radius, size - radius - 1))
    offs = weighted_disc(radius, linear_kernel(radius))
    truth = cells.filter(F.col("g") > 0)
    inner_truth = truth.filter(inner)
    # Matches of inner valid truth against every prediction of the patch.
    hits = match_sums(cells, inner_truth.filter("valid"), offs, patch, patch,
                      with_fp=False).select(*patch, "tp")
    near = truth_reach(truth, offs, patch)
    fp = (cells.filter(inner & F.col("valid") & (F.col("p") > 0))
          .join(near, [*patch, "row", "col"], "left").groupBy(*patch)
          .agg(F.sum(F.col("p") * (1 - F.coalesce("influence", F.lit(0.0)))).alias("fp")))
    base = inner_truth.groupBy(*patch).agg(F.count(F.lit(1)).alias("n_truth"))
    sums = base.join(hits, patch, "left").join(fp, patch, "left").fillna(0.0, ["tp", "fp"])
    sums = sums.withColumn("fn", F.col("n_truth") - F.col("tp"))
    return sums.withColumn("score", tversky(F.col("tp"), F.col("fp"), F.col("fn"), alpha, beta, eps))


def soft_tversky(scored: DataFrame, by: Sequence[str] = (), *, weight: Column | None = None,
                 alpha: float = ALPHA, beta: float = BETA, smooth: float = 1e-6,
                 eps: float = 0.0, hit_weight: Column | None = None) -> DataFrame:
    """Plain soft Tversky of p against 0/1 g, optionally weighted, per group.

    ``weight`` scales all three sums; ``hit_weight`` only the true positives.
    """
    p, g = F.col("p"), F.col("g").cast("double")
    w = weight if weight is not None else F.lit(1.0)
    hw = hit_weight if hit_weight is not None else F.lit(1.0)
    sums = scored.groupBy(*by).agg(
        F.sum(w * hw * p * g).alias("tp"), F.sum(w * p * (1 - g)).alias("fp"),
        F.sum(w * (1 - p) * g).alias("fn"))
    return sums.withColumn("score", tversky(F.col("tp"), F.col("fp"), F.col("fn"), alpha, beta,
                                            eps, smooth))


# --- scored-table losses --------------------------------------------------------------

def bce(p: Column, g: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross entropy with a positive-class weight."""
    g = g.cast("double")
    return -(F.lit(pos_weight) * g * F.log(p) + (1 - g) * F.log(1 - p))


def focal_bce(p: Column, g: Column, gamma: float = 2.0, pos_weight: float = 1.0) -> Column:
    pt = F.when(g > 0, p).otherwise(1 - p)
    return F.pow(1 - pt, F.lit(gamma)) * bce(p, g, pos_weight)


def losses(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Loss terms of a scored table (p strictly inside (0, 1), g, valid) and their mixes."""
    p, g = F.col("p"), F.col("g")
    y, v = g.cast("double"), F.col("valid").cast("double")
    terms = scored.groupBy(*by).agg(
        (F.sum(bce(p, g, 4.0) * v) / F.greatest(F.sum(v), F.lit(1.0))).alias("masked_bce"),
        *[F.avg(bce(p, g, w)).alias(n) for n, w in
          (("bce_4", 4.0), ("bce_2", 2.0), ("bce_1_5", 1.5), ("bce_1", 1.0))],
        F.avg(focal_bce(p, g, 2.0, 4.0)).alias("focal_weighted"),
        F.avg(focal_bce(p, g, 2.0)).alias("focal"),
        F.avg(F.pow(p * (1 - y), F.lit(2.0))).alias("fp_penalty"),
        F.sum(p * y).alias("_tp"), F.sum(p * (1 - y)).alias("_fp"), F.sum((1 - p) * y).alias("_fn"))
    sums = F.col("_tp"), F.col("_fp"), F.col("_fn")
    terms = (terms.withColumn("tversky_loss", 1 - tversky(*sums, eps=0.0, smooth=1e-6))
             .withColumn("tversky_loss_37", 1 - tversky(*sums, alpha=0.3, beta=0.7, eps=1e-7)))
    mix = {
        "mix_half": [(0.5, "masked_bce"), (0.5, "tversky_loss")],
        "mix_bce_focal": [(0.45, "bce_4"), (0.55, "focal_weighted")],
        "mix_tversky_focal_bce": [(0.55, "tversky_loss"), (0.30, "focal"), (0.15, "bce_2")],
        "mix_tversky_focal_fp": [(0.55, "tversky_loss"), (0.30, "focal"), (0.15, "fp_penalty")],
        "mix_bce_tversky": [(0.55, "bce_1_5"), (0.45, "tversky_loss")],
        "mix_bce_tversky_37": [(0.55, "bce_1"), (0.45, "tversky_loss_37")],
    }
    for name, parts in mix.items():
        terms = terms.withColumn(name, sum(F.lit(w) * F.col(c) for w, c in parts))
    return terms.drop("_tp", "_fp", "_fn")
