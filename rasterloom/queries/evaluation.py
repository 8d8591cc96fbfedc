"""Threshold, ranking, histogram and comparison queries."""

from pyspark.sql import functions as F

from ..functions.values import error_class
from ..operators import evaluation as E
from ..operators.features import summary
from ..operators.ordering import best_first, global_rank, top_k
from . import query
from .fixtures import grid, grid2, other, shape, six, sql, truth

CUTS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
NINE = CUTS[:9]


def cut_values(cuts, name="t"):
    return f"cuts({name}) AS (VALUES " + ", ".join(f"({c!r}::DOUBLE)" for c in cuts) + ")"


@query(sql('''SELECT t AS threshold, count(*) FILTER (p >= t) AS n, round(100e0 * count(*) FILTER (p >= t) / count(*), 6) AS percent
    FROM grid, cuts GROUP BY 1''', "grid", cut_values(CUTS)))
def exceedance_counts(spark, sf):
    return six(E.exceedance(grid(spark, sf), CUTS), "percent")


_PR = '''SELECT t AS threshold, count(*) FILTER (p >= t AND g > 0) AS tp, count(*) FILTER (p >= t AND g = 0) AS fp,
    count(*) FILTER (p < t AND g > 0) AS fn FROM grid, cuts GROUP BY 1'''


@query(sql(f'''SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0e0 END, 6) AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0e0 END, 6) AS recall FROM ({_PR})''', "grid", cut_values(NINE)))
def threshold_sweep(spark, sf):
    return six(E.threshold_sweep(grid(spark, sf), NINE), "precision", "recall")


@query(sql(f'''SELECT 'tiny' AS guard, *, round(tp / (tp + fp + 1e-12), 6) AS precision, round(tp / (tp + fn + 1e-12), 6) AS recall FROM ({_PR})
    UNION ALL SELECT 'small', *, round(tp / (tp + fp + 1e-7), 6), round(tp / (tp + fn + 1e-7), 6) FROM ({_PR})''', "grid", cut_values(NINE)))
def threshold_sweep_guarded(spark, sf):
    g = grid(spark, sf)
    a, b = (E.threshold_sweep(g, NINE, guard).withColumn("guard", F.lit(n)) for n, guard in (("tiny", 1e-12), ("small", 1e-7)))
    return six(a.unionByName(b), "precision", "recall")


@query(sql('''SELECT CAST(g AS INTEGER) AS label, count(*) FILTER (p < 0.5e0) AS predicted_0, count(*) FILTER (p >= 0.5e0) AS predicted_1
    FROM grid GROUP BY 1''', "grid"))
def confusion_matrix(spark, sf):
    return E.confusion_matrix(grid(spark, sf))


@query(sql('''SELECT "class", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
    SELECT '0' AS "class", p0 AS precision, r0 AS recall, 2 * p0 * r0 / (p0 + r0) AS f1, n0 AS support FROM k
    UNION ALL SELECT '1', p1, r1, 2 * p1 * r1 / (p1 + r1), n1 FROM k
    UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM k
    UNION ALL SELECT 'macro', (p0 + p1) / 2, (r0 + r1) / 2, (2 * p0 * r0 / (p0 + r0) + 2 * p1 * r1 / (p1 + r1)) / 2, n FROM k
    UNION ALL SELECT 'weighted', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n,
      (2 * p0 * r0 / (p0 + r0) * n0 + 2 * p1 * r1 / (p1 + r1) * n1) / n, n FROM k)''', "grid",
           '''c AS (SELECT count(*) FILTER (p >= 0.5e0 AND g > 0) AS tp, count(*) FILTER (p >= 0.5e0 AND g = 0) AS fp,
      count(*) FILTER (p < 0.5e0 AND g > 0) AS fn, count(*) FILTER (p < 0.5e0 AND g = 0) AS tn FROM grid)''',
           '''k AS (SELECT tp / (tp + fp)::DOUBLE AS p1, tp / (tp + fn)::DOUBLE AS r1, tn / (tn + fn)::DOUBLE AS p0,
      tn / (tn + fp)::DOUBLE AS r0, tp + fn AS n1, tn + fp AS n0, tp + fp + fn + tn AS n,
      (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS acc FROM c)'''))
def classification_report(spark, sf):
    return six(E.classification_report(grid(spark, sf)), "precision", "recall", "f1")


@query(sql('''SELECT tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall,
    round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0e0 END, 6) AS f1 FROM (
      SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0e0 END AS pr,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0e0 END AS rc FROM (
        SELECT count(*) FILTER (p >= 0.9e0 AND g > 0) AS tp, count(*) FILTER (p >= 0.9e0 AND g = 0) AS fp,
          count(*) FILTER (p < 0.9e0 AND g > 0) AS fn FROM grid WHERE valid))''', "grid"))
def candidate_map_scores(spark, sf):
    flagged = grid(spark, sf).filter("valid").withColumn("selected", F.col("p") >= 0.9)
    return six(E.map_counts(flagged), "precision", "recall", "f1")


@query(sql('''SELECT CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg,
    round((sum(rank * pos) - np * (np + 1) / 2e0) / (np * nn::DOUBLE), 6) AS roc_auc,
    round(sum(pos * ctp / (ctp + cfp)::DOUBLE) / np, 6) AS average_precision FROM (
      SELECT *, sum(pos) OVER () AS np, sum(neg) OVER () AS nn,
        sum(pos + neg) OVER (ORDER BY p) - (pos + neg) + (pos + neg + 1) / 2e0 AS rank,
        sum(pos) OVER (ORDER BY p DESC) AS ctp, sum(neg) OVER (ORDER BY p DESC) AS cfp FROM (
        SELECT p, count(*) FILTER (g > 0) AS pos, count(*) FILTER (g = 0) AS neg FROM grid2 GROUP BY 1)) GROUP BY np, nn''', "grid2"))
def roc_auc_and_ap(spark, sf):
    return six(E.ranking_scores(grid2(spark, sf)), "roc_auc", "average_precision")


KS = [50, 100, 500, 1000, 5000, 1_000_000]


@query(sql('''SELECT CAST(k AS INTEGER) AS k, n_used, tp, round(tp / n_used::DOUBLE, 6) AS precision, round(tp / nt::DOUBLE, 6) AS recall, threshold FROM (
    SELECT k, count(*) AS n_used, count(*) FILTER (g > 0) AS tp, min(p) AS threshold,
      (SELECT count(*) FROM grid WHERE g > 0) AS nt
    FROM (SELECT *, row_number() OVER (ORDER BY p DESC, "row" DESC, col DESC) AS rank FROM grid), cuts WHERE rank <= k GROUP BY 1)''',
           "grid", "cuts(k) AS (VALUES " + ", ".join(f"({k})" for k in KS) + ")"))
def k_curve(spark, sf):
    return six(E.k_curve(grid(spark, sf), KS), "precision", "recall")


@query(sql('''SELECT row_number() OVER (ORDER BY p DESC, "row" DESC, col DESC) AS rank, "row", col, p FROM grid''', "grid"))
def score_rank(spark, sf):
    return global_rank(grid(spark, sf).select("row", "col", "p"), best_first())


@query(sql('''SELECT "row", col, p FROM grid ORDER BY p DESC, "row" DESC, col DESC LIMIT 200''', "grid"))
def top_k_scores(spark, sf):
    return top_k(grid(spark, sf).select("row", "col", "p"), 200, best_first())


@query(sql('''SELECT i AS bin, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(50)) AS INTEGER) AS i) LEFT JOIN (
    SELECT CAST(least(floor((p - lo) / (hi - lo) * 50), 49) AS INTEGER) AS b, count(*) AS n
    FROM grid, (SELECT min(p) AS lo, max(p) AS hi FROM grid) GROUP BY 1) ON b = i''', "grid"))
def score_histogram(spark, sf):
    return E.histogram(grid(spark, sf), "p", 50)


_EDGE = "list_transform(range(20), lambda i: CAST(floor(i * ({n} / 20e0)) AS BIGINT))"


@query(sql(f'''SELECT CAST(gy AS INTEGER) AS grid_row, CAST(gx AS INTEGER) AS grid_col, count(p) AS n, round(coalesce(avg(p), 0), 6) AS mean_p,
    coalesce(max(p), 0e0) AS max_p FROM (SELECT unnest(range(20)) AS gy) CROSS JOIN (SELECT unnest(range(20)) AS gx)
    LEFT JOIN (SELECT p, len(list_filter({_EDGE.format(n="h")}, lambda e: e <= "row")) - 1 AS cy,
      len(list_filter({_EDGE.format(n="wd")}, lambda e: e <= col)) - 1 AS cx FROM grid, size)
    ON cy = gy AND cx = gx GROUP BY 1, 2''', "grid", "size"))
def density_grid(spark, sf):
    size = shape(spark, sf)
    return six(E.density_grid(grid(spark, sf, size), size.height, size.width), "mean_p")


_PAIRS = 'pairs AS (SELECT a."row", a.col, a.p AS a, b.p AS b FROM grid a JOIN other b ON a."row" = b."row" AND a.col = b.col)'


def pairs(spark, sf):
    size = shape(spark, sf)
    return E.aligned(grid(spark, sf, size), other(spark, sf, size))


@query(sql('''SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mean_abs, round(max(abs(a - b)), 6) AS max_abs,
    round(corr(a, b), 6) AS pearson, round(quantile_cont(abs(a - b), 0.5), 6) AS median_abs,
    round(quantile_cont(abs(a - b), 0.95), 6) AS p95_abs, round(quantile_cont(abs(a - b), 0.99), 6) AS p99_abs FROM pairs''',
           "grid", "other", _PAIRS))
def raster_difference(spark, sf):
    return six(E.raster_difference(pairs(spark, sf)), "mean_abs", "max_abs", "pearson", "median_abs", "p95_abs", "p99_abs")


@query(sql('''SELECT t AS threshold, count(*) FILTER (a >= t AND b >= t) AS intersection, count(*) FILTER (a >= t OR b >= t) AS union_n,
    round(CASE WHEN count(*) FILTER (a >= t OR b >= t) > 0 THEN count(*) FILTER (a >= t AND b >= t) / (count(*) FILTER (a >= t OR b >= t))::DOUBLE
      ELSE 1e0 END, 6) AS iou FROM pairs, cuts GROUP BY 1''', "grid", "other", _PAIRS, cut_values([0.1, 0.2, 0.5, 0.8, 0.9])))
def iou_thresholds(spark, sf):
    return six(E.iou_sweep(pairs(spark, sf), [0.1, 0.2, 0.5, 0.8, 0.9]), "iou")


@query(sql('''SELECT "row", col, p, error FROM (
    (SELECT "row", col, p, 2 AS error FROM grid WHERE p >= 0.8e0 AND g = 0 ORDER BY p DESC, "row" DESC, col DESC LIMIT 30)
    UNION ALL (SELECT "row", col, p, 3 FROM grid WHERE p < 0.8e0 AND g > 0 ORDER BY p, "row" DESC, col DESC LIMIT 30))''', "grid"))
def top_errors(spark, sf):
    flagged = grid(spark, sf).select("row", "col", "p", error_class(F.col("p") >= 0.8, F.col("g") > 0, F.lit(True)).alias("error"))
    return E.top_errors(flagged, 30)


@query(sql('''SELECT t AS threshold, "row", col, p, CAST(n AS INTEGER) AS error_rank FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p DESC, "row" DESC, col DESC) AS n
    FROM grid, cuts WHERE p >= t AND g = 0) WHERE n <= 10''', "grid", cut_values([0.5, 0.7, 0.9])))
def top_errors_per_threshold(spark, sf):
    return E.top_false_positives(grid(spark, sf), [0.5, 0.7, 0.9], 10)


_SUMMARY = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(sql('''SELECT g, count(*) AS n, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, min(p) AS min, max(p) AS max,
    ''' + ", ".join(f"round(quantile_cont(p, {q}), 6) AS {n}" for n, q in _SUMMARY.items()) + " FROM grid GROUP BY 1", "grid"))
def score_summary_by_label(spark, sf):
    return six(summary(grid(spark, sf), "p", _SUMMARY, ["g"]), "mean", "std", *_SUMMARY)


_DIST = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_5": 0.995, "p99_9": 0.999}


@query(sql('''SELECT count(*) AS n, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, min(p) AS min, max(p) AS max,
    ''' + ", ".join(f"round(quantile_cont(p, {q}), 6) AS {n}" for n, q in _DIST.items()) + " FROM grid2", "grid2"))
def distribution_summary(spark, sf):
    return six(summary(grid2(spark, sf), "p", _DIST), "mean", "std", *_DIST)
