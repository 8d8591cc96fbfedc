"""Per-band statistics, correlations and effect sizes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.values import all_valid
from ..session import checkpoint
from .grid import stack_bands
from .ordering import match_null_safe, percentiles_wide, with_average_ranks
from .sampling import sample_exact

QUANTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def summary(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population std, min, max and exact percentiles per group."""
    by, v = list(by), F.col(value)
    good = df.filter(v.isNotNull() & ~F.isnan(v))
    base = good.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    pct = percentiles_wide(good, value, named, by)
    if by:
        return match_null_safe(base, pct, by)
    one = pct.select(F.struct(*named)).scalar()
    return base.select("*", *[one[n].alias(n) for n in named])


def feature_stats(df: DataFrame, bands: list[str]) -> DataFrame:
    """mean, std, variance (population), min, median, max per band."""
    out = summary(stack_bands(df, bands), "value", {"median": 0.5}, ["band", "feature"])
    return out.withColumn("variance", F.col("std") * F.col("std")).drop("n")


def cohort_stats(df: DataFrame, bands: list[str], cohort: str) -> DataFrame:
    """Robust statistics per band and cohort."""
    return summary(stack_bands(df, bands, cohort), "value", QUANTILES, ["band", "feature", cohort])


def _pairs(bands: list[str]) -> list[tuple[int, int]]:
    return list(combinations(range(len(bands)), 2))


def pearson_pairs(df: DataFrame, bands: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson r of each unordered band pair in one aggregation: by..., a, b, r."""
    pairs = _pairs(bands)
    one = df.filter(all_valid(bands)).groupBy(*by).agg(*[
        F.corr(bands[i], bands[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    return one.select(*by, F.inline(F.array(*[
        F.struct(F.lit(bands[i]).alias("a"), F.lit(bands[j]).alias("b"),
                 F.col(f"r_{i}_{j}").alias("r")) for i, j in pairs])))


def spearman_pairs(df: DataFrame, bands: list[str], sample: int | None = None) -> DataFrame:
    """Spearman rho per band pair over all rows, or on an exact-count sample where one is asked for."""
    good = df.filter(all_valid(bands)).select("row", "col", *bands)
    if sample:
        good = sample_exact(good, sample)
    # Stored: it is counted, its ranges are drawn from it, and then it is ranked.
    good = checkpoint(good)
    long = stack_bands(good, bands, "row", "col").select("row", "col", "band", "value")
    ranks = with_average_ranks(long, "value", ["band"], ["row", "col"], rows=good.count() * len(bands))
    wide = (ranks.groupBy("row", "col")
            .agg(*[F.max(F.when(F.col("band") == i, F.col("avg_rank"))).alias(b) for i, b in enumerate(bands, start=1)]))
    return pearson_pairs(wide, bands)


def strong_pairs(pairs: DataFrame, cuts: Sequence[float] = (0.90, 0.95, 0.99)) -> DataFrame:
    """Pairs at |r| >= cut for each cut, strongest first: cut, a, b, r, abs_r."""
    cut = F.explode(F.array(*[F.lit(float(c)) for c in cuts]))
    return (pairs.withColumn("abs_r", F.abs("r")).withColumn("cut", cut)
            .filter(F.col("abs_r") >= F.col("cut"))
            .select("cut", "a", "b", "r", "abs_r").orderBy("cut", F.col("abs_r").desc()))


def label_correlation(df: DataFrame, bands: list[str], label: str = "g") -> DataFrame:
    """Point-biserial correlation of each band with the 0/1 label."""
    one = df.agg(*[F.corr(b, F.col(label).cast("double")).alias(b) for b in bands])
    return stack_bands(one, bands).select("band", "feature", F.col("value").alias("r"),
                                          F.abs("value").alias("abs_r"))


def effect_sizes(df: DataFrame, bands: list[str], cohort: str, background: str = "background",
                 groups: Sequence[str] = ("fault", "tp", "fp")) -> DataFrame:
    """(group - background) / background std for mean and median; NULL when std is 0.

    Adds ``effect_rank`` by absolute mean effect of the first group.
    """
    long = stack_bands(df, bands, cohort)
    stats = summary(long, "value", {"median": 0.5}, ["band", "feature", cohort])
    wide = stats.groupBy("band", "feature").agg(*[
        F.max(F.when(F.col(cohort) == c, F.col(s))).alias(f"{c}_{s}")
        for c in (background, *groups) for s in ("mean", "median", "std")])
    sd = F.col(f"{background}_std")
    for c in groups:
        for s, name in (("mean", "effect"), ("median", "median_effect")):
            wide = wide.withColumn(f"{c}_{name}", F.when(
                sd > 0, (F.col(f"{c}_{s}") - F.col(f"{background}_{s}")) / sd))
    lead = F.abs(F.col(f"{groups[0]}_effect"))
    wide = wide.withColumn("effect_rank", F.row_number().over(
        Window.orderBy(lead.desc_nulls_last(), F.col("band").asc())))   # one row per band
    return wide.drop(*[f"{c}_std" for c in (background, *groups)])


def cohort_gap(effects: DataFrame, a: str = "tp", b: str = "fp") -> DataFrame:
    """Mean difference of two cohorts per band, sorted by its absolute value."""
    gap = F.col(f"{a}_mean") - F.col(f"{b}_mean")
    return (effects.select("band", "feature", f"{a}_mean", f"{b}_mean", gap.alias("difference"),
                           F.abs(gap).alias("abs_difference"))
            .orderBy(F.col("abs_difference").desc(), "band"))
