"""Radius search, coordinate lookup and search circles; the nearest truth is in ``transform``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import EARTH_RADIUS_KM, destination, haversine_km
from ..session import checkpoint
from .ordering import few
from .transform import nearest_truth  # noqa: F401


def _level(half: Column) -> Column:
    """Power of two of the cell size, in degrees, on which a span of 2 * half takes 4 to 9 cells."""
    return F.ceil(F.log2(F.greatest(half, F.lit(1e-6)))).cast("int") - 1


def radius_search(candidates: DataFrame, searches: DataFrame) -> DataFrame:
    """Candidates within each search circle, with haversine distance.

    candidates  longitude, latitude and further columns
    searches    search_id, lon, lat, radius_km
    A pyramid of latitude/longitude cells: a circle is looked up on the level of its own size,
    where its bounding box takes a few dozen cells, so a huge circle changes nothing for small
    ones.  Candidates are placed on the levels in use; the exact distance decides.
    """
    half_lat = F.degrees(F.col("radius_km") / EARTH_RADIUS_KM)
    ratio = F.sin(F.col("radius_km") / EARTH_RADIUS_KM) / F.cos(F.radians("lat"))
    # Near a pole the circle spans every longitude.
    half_lon = F.when((F.abs(F.col("lat")) + half_lat < 90) & (ratio < 1), F.degrees(F.asin(ratio))).otherwise(F.lit(180.0))
    pad = 1e-9
    sized = (searches.withColumn("_hy", half_lat).withColumn("_hx", half_lon)
             .withColumn("_ly", _level(F.col("_hy"))).withColumn("_lx", _level(F.col("_hx"))))

    def size(level: Column) -> Column:
        return F.pow(F.lit(2.0), level)

    def cells(centre: Column, half: Column, level: Column) -> Column:
        return F.sequence(F.floor((centre - half - pad) / size(level)), F.floor((centre + half + pad) / size(level)))

    # Pairs of powers of two: the range of a double bounds them, not the data.
    levels = sorted((r["_ly"], r["_lx"]) for r in sized.select("_ly", "_lx").distinct().collect())
    # A circle across the date line also looks on the other side of it.
    lons = F.explode(F.array(F.col("lon"), F.col("lon") - 360.0, F.col("lon") + 360.0))
    boxed = (sized.withColumn("_lon", lons)
             .filter((F.col("_lon") + F.col("_hx") >= -180.0) & (F.col("_lon") - F.col("_hx") <= 180.0))
             .withColumn("_cy", F.explode(cells(F.col("lat"), F.col("_hy"), F.col("_ly"))))
             .withColumn("_cx", F.explode(cells(F.col("_lon"), F.col("_hx"), F.col("_lx"))))
             .drop("_lon", "_hy", "_hx").dropDuplicates(["search_id", "_cy", "_cx"]))
    on = F.array(*[F.struct(F.lit(y).cast("int").alias("_ly"), F.lit(x).cast("int").alias("_lx")) for y, x in levels])
    if not levels:
        on = F.array().cast("array<struct<_ly:int,_lx:int>>")
    placed = (candidates.withColumn("_on", F.explode(on)).select(*candidates.columns, "_on.*")
              .withColumn("_cy", F.floor(F.col("latitude") / size(F.col("_ly"))))
              .withColumn("_cx", F.floor(F.col("longitude") / size(F.col("_lx")))))
    d = haversine_km(F.col("lon"), F.col("lat"), F.col("longitude"), F.col("latitude"))
    # Few search cells are broadcast, so that no crowded cell is a shuffle key; AQE splits those of many.
    return (placed.join(few(checkpoint(boxed)), ["_ly", "_lx", "_cy", "_cx"]).withColumn("distance_km", d)
            .filter(F.col("distance_km") <= F.col("radius_km")).drop("_ly", "_lx", "_cy", "_cx"))


def search_summary(hits: DataFrame, searches: DataFrame) -> DataFrame:
    """Hit count and nearest distance per search; searches without hits show 0 and NULL."""
    per = hits.groupBy("search_id").agg(F.count(F.lit(1)).alias("nearby_count"),
                                        F.min("distance_km").alias("nearest_km"))
    return (searches.select("search_id").join(per, "search_id", "left")
            .select("search_id", F.coalesce("nearby_count", F.lit(0)).alias("nearby_count"), "nearest_km"))


SORTS = {"distance": [("distance_km", True)], "rank": [("rank", True)], "score": [("score", False)]}


def sorted_results(hits: DataFrame, by: str = "distance", limit: int | None = 25) -> DataFrame:
    """User-chosen order (distance, rank or score) with ``rank`` as tie-break and a limit."""
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in SORTS[by]]
    keys += [F.col(c).asc() for c in ("rank", "search_id") if c in hits.columns]
    out = hits.orderBy(*keys)
    return out.limit(limit) if limit else out


def coordinate_lookup(candidates: DataFrame, wanted: DataFrame, tol: float = 1e-6) -> DataFrame:
    """First candidate by rank within ``tol`` degrees on both axes of each wanted point.

    wanted: lookup_id, lon, lat.
    """
    def key(axis: Column) -> Column:
        return F.floor(axis / tol).cast("long")

    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = (wanted.withColumn("_kx", F.explode(F.transform(near, lambda d: d + key(F.col("lon")))))
              .withColumn("_ky", F.explode(F.transform(near, lambda d: d + key(F.col("lat"))))))
    placed = candidates.withColumn("_kx", key(F.col("longitude"))).withColumn("_ky", key(F.col("latitude")))
    ok = ((F.abs(F.col("lon") - F.col("longitude")) < tol) & (F.abs(F.col("lat") - F.col("latitude")) < tol))
    cols = [c for c in candidates.columns]
    return (spread.join(placed, ["_kx", "_ky"]).filter(ok)
            .groupBy("lookup_id").agg(F.min_by(F.struct(*cols), "rank").alias("m"))
            .select("lookup_id", "m.*"))


def search_circle(searches: DataFrame, segments: int = 128) -> DataFrame:
    """Closed ring of segments + 1 points around each search: search_id, i, longitude, latitude."""
    step = F.explode(F.sequence(F.lit(0), F.lit(segments)))
    pts = searches.withColumn("i", step)
    lon, lat = destination(F.col("lon"), F.col("lat"), F.col("i") / segments * F.lit(math.pi) * 2,
                           F.col("radius_km"))
    return pts.select("search_id", "i", lon.alias("longitude"), lat.alias("latitude"))


def circle_rings(points: DataFrame) -> DataFrame:
    """Collect the fixed number of ring points of each search into one ordered array."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("i", "longitude", "latitude"))),
                       lambda s: F.array(s["longitude"], s["latitude"]))
    return points.groupBy("search_id").agg(ring.alias("ring"))
