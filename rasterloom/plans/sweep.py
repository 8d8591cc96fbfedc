"""Parameter sweeps over power, threshold, top-K and thinning radius in one job each.

Every cut family is nested (p >= t, rank <= K).  A cut on p^power is a cut on p at t^(1/power), so
all cuts of all powers are one sorted table of breakpoints, and a pixel is binned once: at the
first breakpoint that admits it.  A bin holds a vector with one sum per power: false positives, and
the rises of each truth pixel's best match while its at most 25 neighbours are admitted in order.
Running sums over the bins answer every (power, cut).  No row is multiplied by powers or cuts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kernels import linear_kernel, weighted_disc
from ..operators.evaluation import with_precision_recall
from ..operators.metric import ALPHA, BETA, EPS, RADIUS, spread_truth, truth_reach, tversky
from ..operators.ordering import best_first, top_k
from ..operators.thinning import thin
from ..session import checkpoint


@dataclass(frozen=True)
class Steps:
    """Breakpoints in the order in which they admit pixels.

    column   what is cut: p (value >= edge, edges falling) or pick_rank (value <= edge, rising)
    answers  (power number, level number, bin): the cut of that level is the bins up to that one
    """

    column: str
    edges: tuple[float, ...]
    answers: tuple[tuple[int, int, int], ...]

    def bins(self, values: np.ndarray) -> np.ndarray:
        """First edge that admits each value; len(edges) = none."""
        edges = np.array(self.edges)
        return np.searchsorted(-edges, -values, "left") if self.column == "p" else np.searchsorted(edges, values, "left")


def _least_admitted(cut: float, power: float) -> float:
    """The smallest p with p^power >= cut."""
    if cut <= 0:
        return 0.0
    p = cut ** (1.0 / power)
    while p > 0 and math.nextafter(p, 0.0) ** power >= cut:
        p = math.nextafter(p, 0.0)
    while p ** power < cut:
        p = math.nextafter(p, math.inf)
    return p


def powered_steps(powers: Sequence[float], cuts: Sequence[float]) -> Steps:
    """Cuts on p^power, from high to low."""
    marks = [[_least_admitted(c, e) for c in cuts] for e in powers]
    edges = sorted({m for row in marks for m in row}, reverse=True)
    at = {m: i for i, m in enumerate(edges)}
    return Steps("p", tuple(edges), tuple((e, k, at[m]) for e, row in enumerate(marks) for k, m in enumerate(row)))


def plain_steps(column: str, powers: Sequence[float], cuts: Sequence[float]) -> Steps:
    """The same cuts for every power, in the order given."""
    return Steps(column, tuple(float(c) for c in cuts), tuple((e, k, k) for e in range(len(powers)) for k in range(len(cuts))))


def _sweep(pred: DataFrame, truth: DataFrame, powers: Sequence[float], steps: Steps, radius: float,
           by: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """by..., level_no, power, tp, fp, fn, n_truth, selected, hits, threshold_raw for all answers.

    ``pred``: row, col, p and the column that ``steps`` cuts.  ``by`` names an integer column of
    ``pred`` with its values: each value is a selection of its own.
    """
    by = by or {}
    keys, exponents = list(by), [float(e) for e in powers]
    offsets = weighted_disc(radius, linear_kernel(radius))
    hot = pred.filter(F.col("p") > 0)
    cut = F.col(steps.column).cast("double").alias("cut")
    sums = [f"s{i}" for i in range(len(exponents))]
    types = "".join(f"`{k}` int, " for k in keys) + "bin int, "

    def grouped(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
        """The rows of each selection."""
        if not keys:
            yield (), batch
            return
        own = np.column_stack([batch.column(i).to_numpy() for i in range(len(keys))])
        for key in np.unique(own, axis=0):
            yield tuple(key.tolist()), batch.filter(pa.array((own == key).all(axis=1)))

    def rows(total: dict[tuple[int, ...], list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
        for key, columns in total.items():
            at = np.flatnonzero(columns[0])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.full(len(at), k, np.int32)) for k in key), pa.array(at.astype(np.int32)),
                 *(pa.array(c[at]) for c in columns)], [*keys, "bin", *names])

    # False positives, counts and hits: one row per bin and task.
    def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = len(steps.edges), {}
        for key, part in (x for batch in batches for x in grouped(batch)):
            p, value, mark = (part.column(len(keys) + i).to_numpy() for i in range(3))
            bins = steps.bins(value)
            known = bins < n
            p, mark, bins = p[known], mark[known], bins[known]
            own = total.setdefault(key, [np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.inf),
                                         *(np.zeros(n) for _ in exponents)])
            own[0] += np.bincount(bins, minlength=n)
            own[1] += np.bincount(bins[mark == 1.0], minlength=n)
            np.minimum.at(own[2], bins, p)
            for i, e in enumerate(exponents):
                own[3 + i] += np.bincount(bins, p ** e * (1 - mark), n)
        yield from rows(total, ["selected", "hits", "low", *sums])

    marks = F.coalesce(F.col("influence"), F.lit(0.0)).alias("mark")
    fp = (hot.join(truth_reach(truth, offsets), ["row", "col"], "left").select(*keys, F.col("p").cast("double"), cut, marks)
          .mapInArrow(misses, types + "selected long, hits long, low double, " + ", ".join(f"{s} double" for s in sums))
          .groupBy(*keys, "bin").agg(F.sum("selected").alias("selected"), F.sum("hits").alias("hits"), F.min("low").alias("low"),
                                     *[F.sum(s).alias(s.replace("s", "f", 1)) for s in sums]))

    # True positives: the neighbours of a truth pixel (bounded) stay in one row.  Admitted in order,
    # each rise of the best match is credited to the bin that brings it.
    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = len(steps.edges), {}
        for key, part in (x for batch in batches for x in grouped(batch)):
            lists = part.column(len(keys))
            sizes = pc.list_value_length(lists).to_numpy()
            flat = pc.list_flatten(lists)
            p, value, w = (flat.field(i).to_numpy() for i in range(3))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            bins = steps.bins(value)
            order = np.argsort(owner * (n + 1) + bins, kind="stable")
            p, w, bins, owner = p[order], w[order], bins[order], owner[order]
            place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = total.setdefault(key, [np.zeros(n, np.int64), *(np.zeros(n) for _ in exponents)])
            known = bins < n
            own[0] += np.bincount(bins[known], minlength=n)
            best = np.zeros((len(sizes), int(sizes.max(initial=0))))
            for i, e in enumerate(exponents):
                best[:] = 0.0
                best[owner, place] = p ** e * w
                np.maximum.accumulate(best, axis=1, out=best)
                rise = np.diff(best, axis=1, prepend=0.0)[owner, place]
                own[1 + i] += np.bincount(bins[known], rise[known], n)
        yield from rows(total, ["met", *sums])

    around = (spread_truth(truth, offsets).join(hot, ["row", "col"]).groupBy(*keys, "t_row", "t_col")
              .agg(F.collect_list(F.struct(F.col("p").cast("double"), cut, "w")).alias("near")))
    tp = (around.select(*keys, "near").mapInArrow(gains, types + "met long, " + ", ".join(f"{s} double" for s in sums))
          .groupBy(*keys, "bin").agg(*[F.sum(s).alias(s.replace("s", "t", 1)) for s in sums]))

    # Small from here: one row per bin, then one per answer.
    spark = pred.sparkSession
    frame = spark.range(len(steps.edges)).select(F.col("id").cast("int").alias("bin"))
    for name, values in by.items():
        frame = frame.withColumn(name, F.explode(F.array(*[F.lit(int(v)) for v in values])))
    table = frame.join(F.broadcast(fp), [*keys, "bin"], "left").join(F.broadcast(tp), [*keys, "bin"], "left")
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = table.select(
        *keys, "bin", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("long").alias(c) for c in ("selected", "hits")],
        F.coalesce(F.min("low").over(upto), F.lit(0.0)).alias("threshold_raw"),
        *[F.array(*[F.coalesce(F.sum(f"{c}{i}").over(upto), F.lit(0.0)) for i in range(len(sums))]).alias(name)
          for c, name in (("t", "tps"), ("f", "fps"))])
    answers = spark.createDataFrame([(e, exponents[e], k, b) for e, k, b in steps.answers], "e int, power double, level_no int, bin int")
    n_truth = truth.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = answers.join(F.broadcast(running), "bin").select(
        *keys, "power", "level_no", F.get("tps", "e").alias("tp"), F.get("fps", "e").alias("fp"), "selected", "hits", "threshold_raw")
    return out.withColumn("n_truth", n_truth).withColumn("fn", F.col("n_truth") - F.col("tp"))


def _scored(table: DataFrame, alpha: float, beta: float) -> DataFrame:
    return table.withColumn("dti", tversky(F.col("tp"), F.col("fp"), F.col("fn"), alpha, beta, EPS))


def _name_level(table: DataFrame, cuts: Sequence[float], name: str, as_type: str) -> DataFrame:
    arr = F.array(*[F.lit(c) for c in cuts])
    return table.withColumn(name, F.get(arr, F.col("level_no")).cast(as_type)).drop("level_no")


def power_sweep(pred: DataFrame, truth: DataFrame, powers: Sequence[float], radius: float = RADIUS,
                alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """DTI of p^power for each power."""
    out = _sweep(pred.select("row", "col", "p"), truth, powers, plain_steps("p", powers, [0.0]), radius)
    return _scored(out, alpha, beta).drop("level_no")


def threshold_power_sweep(pred: DataFrame, truth: DataFrame, powers: Sequence[float],
                          thresholds: Sequence[float], when: str = "after", radius: float = RADIUS,
                          alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """DTI for each power and threshold, the threshold on p^power ("after") or p ("before")."""
    if when not in ("after", "before"):
        raise ValueError("when is 'after' or 'before'")
    cuts = sorted((float(t) for t in thresholds), reverse=True)
    steps = powered_steps(powers, cuts) if when == "after" else plain_steps("p", powers, cuts)
    out = _sweep(pred.select("row", "col", "p"), truth, powers, steps, radius)
    return _name_level(_scored(out, alpha, beta), cuts, "threshold", "double")


def _rank_sweep(ranked: DataFrame, truth: DataFrame, ks: Sequence[int], powers: Sequence[float],
                radius: float, alpha: float, beta: float,
                by: dict[str, Sequence[int]] | None = None) -> DataFrame:
    cuts = sorted(int(k) for k in ks)
    pred = ranked.filter(F.col("pick_rank") <= cuts[-1]).select("row", "col", "p", "pick_rank", *(by or {}))
    out = _sweep(pred, truth, powers, plain_steps("pick_rank", powers, cuts), radius, by)
    out = _name_level(_scored(out, alpha, beta), cuts, "k", "int")
    counts = out.withColumnsRenamed({"hits": "tp_pixels", "tp": "tp_w", "fp": "fp_w", "fn": "fn_w"})
    counts = (counts.withColumn("tp", F.col("tp_pixels")).withColumn("fp", F.col("selected") - F.col("tp_pixels"))
              .withColumn("fn", F.col("n_truth") - F.col("tp_pixels")))
    return with_precision_recall(counts).withColumnsRenamed(
        {"fp": "fp_pixels", "fn": "fn_pixels"}).drop("tp")


def top_k_sweep(pred: DataFrame, truth: DataFrame, ks: Sequence[int], powers: Sequence[float] = (1.0,),
                radius: float = RADIUS, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """DTI, pixel counts, precision and recall of the top K for each K and power.

    Only the best max(K) pixels are ranked; the others are dropped by score before any shuffle.
    """
    ranked = checkpoint(top_k(pred.select("row", "col", "p"), max(ks), best_first(), rank="pick_rank", lead="p"))
    return _rank_sweep(ranked, truth, ks, powers, radius, alpha, beta)


def thinned_sweep(pred: DataFrame, truth: DataFrame, ks: Sequence[int], powers: Sequence[float],
                  radii: Sequence[int], radius: float = RADIUS, alpha: float = ALPHA,
                  beta: float = BETA) -> DataFrame:
    """K x power x thinning radius.  Scores are stored once for all radii and thinned once per
    radius: picks do not depend on power, and the first K picks are a prefix of the first max(K)."""
    scores = checkpoint(pred.select("row", "col", "p"))
    picks = [thin(scores, r, max(ks), stored=True).withColumn("thin_radius", F.lit(int(r))) for r in radii]
    ranked = reduce(DataFrame.unionByName, picks).withColumnRenamed("thin_rank", "pick_rank")
    return _rank_sweep(checkpoint(ranked), truth, ks, powers, radius, alpha, beta, {"thin_radius": radii})


def fixed_setting(pred: DataFrame, truth: DataFrame, k: int, power: float, thin_radius: int,
                  radius: float = RADIUS) -> DataFrame:
    """One locked setting with all its columns."""
    return thinned_sweep(pred, truth, [k], [power], [thin_radius], radius)


def stack_results(named: dict[str, DataFrame]) -> DataFrame:
    """Experiment tables stacked under a ``model`` column."""
    return reduce(DataFrame.unionByName,
                  [df.withColumn("model", F.lit(n)) for n, df in named.items()])
