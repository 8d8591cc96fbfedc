"""Band statistics, correlations and effect sizes."""

from pyspark.sql import functions as F

from ..operators import features as FE
from . import query
from .cleaning import cohort
from .fixtures import BANDS, bands, six, sql, union_all

_ALL = " AND ".join(f"b{i} IS NOT NULL" for i in range(1, 6))
COHORT = '''CASE WHEN g > 0 AND p >= 0.8e0 THEN 'tp' WHEN p >= 0.8e0 THEN 'fp' WHEN g > 0 THEN 'fault' ELSE 'background' END'''
_IJ = [(i, j) for i in range(1, 6) for j in range(i + 1, 6)]


@query(sql('''SELECT band, feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
    round(var_pop(value), 4) AS variance, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS max
    FROM long WHERE value IS NOT NULL GROUP BY 1, 2''', "long"))
def feature_stats(spark, sf):
    out = six(FE.feature_stats(bands(spark, sf), BANDS), "mean", "std", "median")
    return out.withColumn("variance", F.round("variance", 4))


@query(sql(f'''SELECT band, feature, {COHORT} AS cohort, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
    min(value) AS min, max(value) AS max, ''' + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in FE.QUANTILES.items())
           + " FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3", "long"))
def cohort_stats(spark, sf):
    b = bands(spark, sf).withColumn("cohort", cohort())
    return six(FE.cohort_stats(b, BANDS, "cohort"), "mean", "std", *FE.QUANTILES)


def _pearson(where: str) -> str:
    return " UNION ALL ".join(f"SELECT '{where}' AS part, 'b{i}' AS a, 'b{j}' AS b, round(corr(b{i}, b{j}), 6) AS r FROM bands "
                              f"WHERE {_ALL}{dict(all='', fault=' AND g > 0', background=' AND g = 0')[where]}" for i, j in _IJ)


@query(sql(" UNION ALL ".join(_pearson(w) for w in ("all", "fault", "background")), "bands"))
def pearson_correlations(spark, sf):
    b = bands(spark, sf)
    parts = {"all": b, "fault": b.filter("g > 0"), "background": b.filter("g = 0")}
    return six(union_all([FE.pearson_pairs(df, BANDS).select(F.lit(n).alias("part"), "a", "b", "r")
                          for n, df in parts.items()]), "r")


_RANKS = "ranks AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY b{i}) + (count(*) OVER (PARTITION BY b{i}) - 1) / 2e0 AS r{i}" for i in range(1, 6)) + f" FROM bands WHERE {_ALL})"


@query(sql(" UNION ALL ".join(f"SELECT 'b{i}' AS a, 'b{j}' AS b, round(corr(r{i}, r{j}), 6) AS r FROM ranks" for i, j in _IJ), "bands", _RANKS))
def spearman_correlations(spark, sf):
    """All rows; the sampling form is covered by tests."""
    return six(FE.spearman_pairs(bands(spark, sf), BANDS), "r")


@query(sql("SELECT cut, a, b, round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM pr, (VALUES (0.01e0), (0.02e0), (0.5e0)) c(cut) WHERE abs(r) >= cut",
           "bands", "pr AS (" + " UNION ALL ".join(f"SELECT 'b{i}' AS a, 'b{j}' AS b, corr(b{i}, b{j}) AS r FROM bands WHERE {_ALL}" for i, j in _IJ) + ")"))
def strong_pairs(spark, sf):
    """Cut values fit the test tables, whose bands are nearly independent."""
    return six(FE.strong_pairs(FE.pearson_pairs(bands(spark, sf), BANDS), [0.01, 0.02, 0.5]), "r", "abs_r")


@query(sql("SELECT band, feature, round(corr(value, g), 6) AS r, round(abs(corr(value, g)), 6) AS abs_r FROM long GROUP BY 1, 2", "long"))
def label_correlation(spark, sf):
    return six(FE.label_correlation(bands(spark, sf), BANDS), "r", "abs_r")


_EFF = [f"coh AS (SELECT band, feature, {COHORT} AS c, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS sd "
        "FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3)",
        "wide AS (SELECT band, feature, " + ", ".join(
            f"max({s}) FILTER (c = '{c}') AS {c}_{s}" for c in ("background", "fault", "tp", "fp") for s in ("mean", "median", "sd"))
        + " FROM coh GROUP BY 1, 2)"]


@query(sql("SELECT band, feature, " + ", ".join(f"round({c}_{s}, 6) AS {c}_{s}" for c in ("background", "fault", "tp", "fp") for s in ("mean", "median"))
           + ", " + ", ".join(f"round(({c}_mean - background_mean) / background_sd, 6) AS {c}_effect, "
                              f"round(({c}_median - background_median) / background_sd, 6) AS {c}_median_effect" for c in ("fault", "tp", "fp"))
           + ", CAST(row_number() OVER (ORDER BY abs((fault_mean - background_mean) / background_sd) DESC, band) AS INTEGER) AS effect_rank FROM wide",
           "long", *_EFF))
def effect_sizes(spark, sf):
    out = FE.effect_sizes(bands(spark, sf).withColumn("cohort", cohort()), BANDS, "cohort")
    return six(out, *[c for c in out.columns if c not in ("band", "feature", "effect_rank")])


@query(sql("SELECT band, feature, round(tp_mean, 6) AS tp_mean, round(fp_mean, 6) AS fp_mean, round(tp_mean - fp_mean, 6) AS difference, "
           "round(abs(tp_mean - fp_mean), 6) AS abs_difference FROM wide", "long", *_EFF))
def cohort_gap(spark, sf):
    effects = FE.effect_sizes(bands(spark, sf).withColumn("cohort", cohort()), BANDS, "cohort")
    return six(FE.cohort_gap(effects), "tp_mean", "fp_mean", "difference", "abs_difference")
