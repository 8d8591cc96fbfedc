"""Classification, ranking and raster-comparison measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import best_first, percentiles_wide, running_counts, top_k
from .tiles import ring_distance


def level_in(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the cuts are <= value (0..len)."""
    return sum((F.coalesce((value >= F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0))


def _at_or_above(binned: DataFrame, cuts: Sequence[float], name: str, *sums: Column) -> DataFrame:
    """Spread a small per-level table to every cut it reaches and sum per cut."""
    ordered = F.array(*[F.lit(float(c)) for c in sorted(cuts)])
    return (binned.withColumn(name, F.explode(F.filter(
        F.transform(ordered, lambda c, i: F.struct(c.alias("c"), i.alias("i"))),
        lambda s: s["i"] < F.col("level"))))
        .withColumn(name, F.col(f"{name}.c")).groupBy(name).agg(*sums))


def _all_cuts(like: DataFrame, cuts: Sequence[float], name: str) -> DataFrame:
    return like.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias(name))


def exceedance(scored: DataFrame, cuts: Sequence[float], p: str = "p") -> DataFrame:
    """Count and percentage of scores at or above each cut.

    Rows are counted once per level; the cuts multiply only that small table.
    """
    cuts = sorted(cuts)
    binned = scored.groupBy(level_in(F.col(p), cuts).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = scored.agg(F.count(F.lit(1)).alias("n")).scalar()
    at = _at_or_above(binned, cuts, "threshold", F.sum("n").alias("n"))
    return (_all_cuts(scored, cuts, "threshold").join(at, "threshold", "left")
            .select("threshold", F.coalesce("n", F.lit(0)).alias("n"))
            .withColumn("percent", F.try_divide(F.col("n") * 100.0, total)))


def threshold_sweep(scored: DataFrame, cuts: Sequence[float], guard: float | None = None) -> DataFrame:
    """TP, FP, FN, precision, recall of p >= t against g > 0 for each threshold.

    ``guard`` is added to the denominators; None gives 0 where one is 0.
    """
    cuts = sorted(cuts)
    hit = F.col("g") > 0
    binned = (scored.groupBy(level_in(F.col("p"), cuts).alias("level"))
              .agg(F.count(F.when(hit, 1)).alias("pos"), F.count(F.when(~hit, 1)).alias("neg")))
    at = _at_or_above(binned, cuts, "threshold", F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    truth = scored.agg(F.count(F.when(hit, 1)).alias("n")).scalar()
    out = (_all_cuts(scored, cuts, "threshold").join(at, "threshold", "left").fillna(0, ["tp", "fp"])
           .withColumn("fn", truth - F.col("tp")))
    return with_precision_recall(out, guard)


def _ratio(num: Column, den: Column, guard: float | None) -> Column:
    if guard is not None:
        return num / (den + F.lit(guard))
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def with_precision_recall(counts: DataFrame, guard: float | None = None) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", _ratio(tp, tp + fp, guard)).withColumn(
        "recall", _ratio(tp, tp + fn, guard))


def map_counts(flagged: DataFrame, by: Sequence[str] = (), guard: float | None = None) -> DataFrame:
    """TP, FP, FN, precision, recall, F1 of boolean ``selected`` against g > 0."""
    hit, sel = F.col("g") > 0, F.col("selected")
    counts = flagged.groupBy(*by).agg(
        F.count(F.when(sel & hit, 1)).alias("tp"), F.count(F.when(sel & ~hit, 1)).alias("fp"),
        F.count(F.when(~sel & hit, 1)).alias("fn"))
    out = with_precision_recall(counts, guard)
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both, guard))


def confusion_matrix(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """label, predicted_0, predicted_1."""
    yes = F.col("p") >= threshold
    return scored.groupBy((F.col("g") > 0).cast("int").alias("label")).agg(
        F.count(F.when(~yes, 1)).alias("predicted_0"), F.count(F.when(yes, 1)).alias("predicted_1"))


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, support for both classes, macro and weighted mean, and accuracy."""
    hit, yes = F.col("g") > 0, F.col("p") >= threshold
    cells = scored.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in
                         (("tp", yes & hit), ("fp", yes & ~hit), ("fn", ~yes & hit), ("tn", ~yes & ~hit))])

    def prf(tp: str, fp: str, fn: str) -> list[Column]:
        pr, rc = _ratio(F.col(tp), F.col(tp) + F.col(fp), None), _ratio(F.col(tp), F.col(tp) + F.col(fn), None)
        return [pr, rc, _ratio(2 * pr * rc, pr + rc, None)]

    one, zero = prf("tp", "fp", "fn"), prf("tn", "fn", "fp")
    n1, n0 = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    n = n0 + n1
    acc = (F.col("tp") + F.col("tn")) / n
    macro = [(a + b) / 2 for a, b in zip(zero, one)]
    weighted = [(a * n0 + b * n1) / n for a, b in zip(zero, one)]

    def line(name: str, vals: list[Column], support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), vals[0].alias("precision"), vals[1].alias("recall"),
                        vals[2].alias("f1"), support.alias("support"))

    return cells.select(F.inline(F.array(
        line("0", zero, n0), line("1", one, n1), line("accuracy", [acc] * 3, n),
        line("macro", macro, n), line("weighted", weighted, n))))


def _score_counts(scored: DataFrame) -> DataFrame:
    """Distinct scores with class counts: ties collapse before the range shuffle."""
    hit = F.col("g") > 0
    return scored.groupBy("p").agg(F.count(F.when(hit, 1)).alias("pos"),
                                   F.count(F.when(~hit, 1)).alias("neg"))


def ranking_scores(scored: DataFrame) -> DataFrame:
    """ROC AUC (ties averaged) and average precision in one ordered pass.

    Both are NULL when a class is missing.
    """
    cum = running_counts(_score_counts(scored), [F.col("p").desc()], {"tp": "pos", "fp": "neg"})
    sums = cum.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        # negatives ranked strictly above count against, ties half
        F.sum(F.col("pos").cast("double") * (F.col("fp") - F.col("neg") / 2)).alias("_above"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("_ap"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select("n_pos", "n_neg",
                       F.when(both, 1 - F.col("_above") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
                       F.when(both, F.col("_ap") / F.col("n_pos")).alias("average_precision"))


def k_curve(scored: DataFrame, ks: Sequence[int], rank: str | None = None) -> DataFrame:
    """Per K: rows used, cumulative TP, precision, recall and the K-th score.

    ``rank`` names an existing rank column; otherwise the best max(K) rows are ranked.
    """
    ks = sorted(ks)
    ranked = scored if rank else top_k(scored, ks[-1], best_first(), rank="rank", lead="p")
    r = F.col(rank or "rank")
    # level = number of cuts already passed, so a row belongs to every later cut
    level = sum(((r > F.lit(k)).cast("int") for k in ks), F.lit(0))
    hit = F.col("g") > 0
    binned = ranked.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("pos"), F.min("p").alias("low"))
    truth = scored.agg(F.count(F.when(hit, 1)).alias("n")).scalar()
    cuts = F.array(*[F.lit(k) for k in ks])
    per_k = (binned.withColumn("k", F.explode(F.slice(cuts, F.col("level") + 1, len(ks))))
             .groupBy("k").agg(F.sum("n").alias("n_used"), F.sum("pos").alias("tp"),
                               F.min("low").alias("threshold")))
    return per_k.select("k", "n_used", "tp", (F.col("tp") / F.col("n_used")).alias("precision"),
                        _ratio(F.col("tp"), truth, None).alias("recall"), "threshold")


def histogram(df: DataFrame, value: str, bins: int, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equal-width counts over [min, max]; the last bin is closed; empty bins show 0."""
    v = F.col(value)
    if lo is None or hi is None:
        span = df.agg(F.struct(F.min(v).cast("double").alias("lo"),
                               F.max(v).cast("double").alias("hi")).alias("s")).scalar()
        low, high = span["lo"], span["hi"]
    else:
        low, high = F.lit(float(lo)), F.lit(float(hi))
    width = F.when(high > low, high - low).otherwise(F.lit(1.0))    # one value: all in bin 0
    bin_no = F.least(F.floor((v - low) / width * bins), F.lit(bins - 1)).cast("int")
    counts = (df.filter((v >= low) & (v <= high)).groupBy(bin_no.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    return (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
            .join(F.broadcast(counts), "bin", "left")     # at most ``bins`` rows
            .select("bin", F.coalesce("n", F.lit(0)).alias("n")))


def linspace_edges(size: int, cells: int) -> list[int]:
    """Integer edges of ``cells`` nearly equal intervals over [0, size]."""
    return [int(i * (size / cells)) if i < cells else size for i in range(cells + 1)]


def cell_of(axis: Column, size: int, cells: int) -> Column:
    """Index of the half-open interval that holds ``axis``."""
    return (level_in(axis, linspace_edges(size, cells)[1:cells])).cast("int")


def density_grid(points: DataFrame, height: int, width: int, cells: int = 20) -> DataFrame:
    """Count, mean and max p per grid cell; all cells^2 cells appear."""
    got = points.groupBy(cell_of(F.col("row"), height, cells).alias("grid_row"),
                         cell_of(F.col("col"), width, cells).alias("grid_col")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.max("p").alias("max_p"))
    all_cells = points.sparkSession.range(cells * cells).select(
        F.floor(F.col("id") / cells).cast("int").alias("grid_row"),
        (F.col("id") % cells).cast("int").alias("grid_col"))
    return all_cells.join(F.broadcast(got), ["grid_row", "grid_col"], "left").fillna(
        0, ["n"]).fillna(0.0, ["mean_p", "max_p"])


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rasters joined by pixel: row, col, a, b.  Fails the job on an unmatched pixel."""
    both = (a.select("row", "col", F.col("p").alias("a"), F.lit(True).alias("_a"))
            .join(b.select("row", "col", F.col("p").alias("b"), F.lit(True).alias("_b")),
                  ["row", "col"], "full"))
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    # In a filter, so that it is read whatever columns the caller keeps.
    return both.filter(F.when(whole, F.lit(True)).otherwise(
        F.raise_error(F.lit("rasters differ in shape")).cast("boolean"))).select("row", "col", "a", "b")


def raster_difference(pairs: DataFrame) -> DataFrame:
    """Mean, median, P95, P99 and max absolute difference and Pearson r of a, b."""
    diffs = pairs.withColumn("d", F.abs(F.col("a") - F.col("b")))
    moments = diffs.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_abs"),
                        F.max("d").alias("max_abs"), F.corr("a", "b").alias("pearson"))
    pct = percentiles_wide(diffs, "d", {"median_abs": 0.5, "p95_abs": 0.95, "p99_abs": 0.99})
    one = pct.select(F.struct("*")).scalar()
    return moments.select("*", *[one[c].alias(c) for c in ("median_abs", "p95_abs", "p99_abs")])


def iou_sweep(pairs: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Intersection over union of a >= t and b >= t; 1 when both are empty."""
    cuts = sorted(cuts)
    la, lb = level_in(F.col("a"), cuts), level_in(F.col("b"), cuts)
    binned = pairs.groupBy(la.alias("la"), lb.alias("lb")).agg(F.count(F.lit(1)).alias("n"))
    per = (binned.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))))
           .groupBy("i").agg(
        F.sum(F.when((F.col("la") > F.col("i")) & (F.col("lb") > F.col("i")), F.col("n")).otherwise(0)).alias("intersection"),
        F.sum(F.when((F.col("la") > F.col("i")) | (F.col("lb") > F.col("i")), F.col("n")).otherwise(0)).alias("union_n")))
    return per.select(F.get(F.array(*[F.lit(float(c)) for c in cuts]), F.col("i")).alias("threshold"),
                      "intersection", "union_n",
                      F.when(F.col("union_n") > 0, F.col("intersection") / F.col("union_n"))
                      .otherwise(F.lit(1.0)).alias("iou"))


def distance_shares(distances: DataFrame, limits: Sequence[float], metres: str = "distance_m") -> DataFrame:
    """Share of rows within each distance limit."""
    total = F.count(F.lit(1))
    one = distances.agg(F.array(*[
        F.struct(F.lit(float(m)).alias("within_m"), F.count(F.when(F.col(metres) <= m, 1)).alias("n"),
                 F.try_divide(F.count(F.when(F.col(metres) <= m, 1)), total).alias("share")) for m in limits]).alias("a"))
    return one.select(F.inline("a"))


def top_errors(flagged: DataFrame, per_kind: int) -> DataFrame:
    """Best-scored false positives and lowest-scored false negatives, n of each.

    ``flagged``: row, col, p, error (2 = FP, 3 = FN).
    """
    fp = (flagged.filter("error = 2").orderBy(*best_first()).limit(per_kind))
    fn = (flagged.filter("error = 3").orderBy(F.col("p").asc(), F.col("row").desc(), F.col("col").desc())
          .limit(per_kind))
    return fp.unionByName(fn)


def top_false_positives(scored: DataFrame, cuts: Sequence[float], n: int) -> DataFrame:
    """Best-scored false positives of each threshold, with their rank.

    Whatever passes a cut and is among its n best is among the n best overall, so
    one take-ordered serves all cuts.
    """
    cuts = sorted(cuts)
    wrong = (scored.filter((F.col("g") <= 0) & (F.col("p") >= cuts[0])).select("row", "col", "p"))
    best = wrong.orderBy(*best_first()).limit(n)
    cut = F.explode(F.array(*[F.lit(float(c)) for c in cuts]))
    w = Window.partitionBy("threshold").orderBy(*best_first())
    return (best.withColumn("threshold", cut).filter(F.col("p") >= F.col("threshold"))
            .withColumn("error_rank", F.row_number().over(w)))


def best_of(results: DataFrame, score: str, *first: str) -> DataFrame:
    """The best experiment; the earliest in ``first`` order wins ties."""
    return results.orderBy(F.col(score).desc(), *[F.col(c).asc() for c in first]).limit(1)


def best_per(results: DataFrame, by: Sequence[str], score: str, *first: str) -> DataFrame:
    """Best row of each group of an experiment table, earliest wins ties."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), *[F.col(c).asc() for c in first])
    return results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def chebyshev_shares(points: DataFrame, truth: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Share of points within each Chebyshev distance of truth, as a square dilation test.

    One tile pass serves all limits: it grows the truth square by square and notes
    the first radius that reaches each pixel.
    """
    marks = (points.select("row", "col", F.lit(0).alias("_t"))
             .unionByName(truth.select("row", "col", F.lit(1).alias("_t")))
             .groupBy("row", "col").agg(F.max("_t").alias("_t")))
    near = ring_distance(marks, "_t", max(limits), "d")
    total = F.count(F.lit(1))
    hit = points.select("row", "col").join(near, ["row", "col"])
    one = hit.agg(F.array(*[
        F.struct(F.lit(r).alias("within_px"), F.count(F.when(F.col("d") <= r, 1)).alias("n"),
                 F.try_divide(F.count(F.when(F.col("d") <= r, 1)), total).alias("share")) for r in limits]).alias("a"))
    return one.select(F.inline("a"))
