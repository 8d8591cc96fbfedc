"""Probability map to ranked, separated candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import GeoRef
from ..functions.values import sanitize
from ..operators.grid import with_lonlat
from ..operators.thinning import thin
from ..session import checkpoint


def check_parameters(k: int, power: float, radius: int) -> None:
    """Raise on K <= 0, power <= 0 or radius < 0."""
    if k <= 0:
        raise ValueError("K must be positive")
    if power <= 0:
        raise ValueError("power must be positive")
    if radius < 0:
        raise ValueError("radius must not be negative")


def create_candidates(scored: DataFrame, k: int, power: float, radius: int,
                      valid: str | None = None) -> DataFrame:
    """Mask, keep p > 0, thin, cut to K: rank, row, col, raw p and the powered score.

    Ranking uses raw double p: x -> x^power is monotone on [0, 1], and tiny powers
    would merge distinct scores.  Raises when nothing is positive.
    """
    check_parameters(k, power, radius)
    kept = scored.filter(F.col(valid)) if valid else scored
    kept = kept.withColumn("p", sanitize(F.col("p")))       # scores beyond [0, 1] are clipped before the power
    # Stored once: the scores may come from a model, and four steps below read them.
    positive = checkpoint(kept.filter(F.col("p") > 0).select("row", "col", "p"))
    if positive.isEmpty():
        raise ValueError("no positive score inside the mask")
    return thin(positive, radius, k, stored=True).select(
        F.col("thin_rank").alias("rank"), "row", "col", F.col("p").alias("raw_model_probability"),
        F.pow("p", F.lit(power)).alias("ranking_score"))


def candidate_table(scored: DataFrame, k: int, power: float, radius: int, geo: GeoRef,
                    valid: str | None = None) -> DataFrame:
    """``create_candidates`` with map and geographic coordinates, in sink order."""
    placed = with_lonlat(create_candidates(scored, k, power, radius, valid), geo)
    return placed.select("rank", "row", F.col("col").alias("column"), "raw_model_probability",
                         "ranking_score", "x", "y", "longitude", "latitude")
