"""Coordinates, nearest neighbours and radius search."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import search as S
from ..operators.grid import with_lonlat
from ..operators.ordering import best_first, global_rank
from ..session import checkpoint
from ..sources.tables import search_export
from . import query
from .fixtures import GEO, grid, points, shape, six, sql, table, truth

_HAV = '''2 * 6371e0 * atan2(sqrt(a), sqrt(1 - a))'''
_A = '''pow(sin(radians({lat2} - {lat1}) / 2), 2e0) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2e0)'''


@query(sql('SELECT "row", col, x, y FROM xy', "xy"))
def map_coordinates(spark, sf):
    return grid(spark, sf).select("row", "col", GEO.x(F.col("col")).alias("x"), GEO.y(F.col("row")).alias("y"))


@query(sql('SELECT "row", col, round(longitude, 7) AS longitude, round(latitude, 7) AS latitude FROM points', "points"))
def lonlat_coordinates(spark, sf):
    return with_lonlat(grid(spark, sf), GEO).select(
        "row", "col", F.round("longitude", 7).alias("longitude"), F.round("latitude", 7).alias("latitude"))


@query(sql('SELECT round(min(longitude), 6) AS min_lon, round(max(longitude), 6) AS max_lon, round(min(latitude), 6) AS min_lat, '
           'round(max(latitude), 6) AS max_lat FROM points', "points"))
def geographic_extent(spark, sf):
    return points(spark, sf).agg(*[
        F.round(f(c), 6).alias(n) for n, f, c in (("min_lon", F.min, "longitude"), ("max_lon", F.max, "longitude"),
                                                  ("min_lat", F.min, "latitude"), ("max_lat", F.max, "latitude"))])


_NEAREST = '''near AS (SELECT a."row", a.col, min(sqrt(pow(a."row" - t."row", 2e0) + pow(a.col - t.col, 2e0))) AS d
    FROM grid a, truth t GROUP BY 1, 2)'''


def _nearest(spark, sf):
    size = shape(spark, sf)
    return S.nearest_truth(grid(spark, sf, size), truth(spark, sf, size), GEO.res)


@query(sql('SELECT "row", col, round(d, 6) AS distance_px, round(d * 100, 6) AS distance_m FROM near', "grid", "truth", _NEAREST))
def nearest_truth_distance(spark, sf):
    return six(_nearest(spark, sf), "distance_px", "distance_m")


@query(sql('''SELECT m AS within_m, count(*) FILTER (d * 100 <= m) AS n, round(count(*) FILTER (d * 100 <= m) / count(*)::DOUBLE, 6) AS share
    FROM near, (VALUES (100e0), (300e0), (500e0), (1000e0), (2000e0), (5000e0)) v(m) GROUP BY 1''', "grid", "truth", _NEAREST))
def distance_shares(spark, sf):
    return six(E.distance_shares(_nearest(spark, sf), [100, 300, 500, 1000, 2000, 5000]), "share")


# Every pixel is a candidate; those whose number is divisible by 50 are searches.
_SEARCHES = '''cand AS (SELECT row_number() OVER (ORDER BY p DESC, "row" DESC, col DESC) AS rank, "row", col AS "column", p AS score, longitude, latitude
    FROM points),
  srch AS (SELECT "row"::BIGINT * width + "column" AS search_id, longitude AS lon, latitude AS lat,
    0.5e0 + (("row"::BIGINT * width + "column") // 50) % 3 AS radius_km FROM cand, w WHERE ("row"::BIGINT * width + "column") % 50 = 0)'''
_HITS = f'''hits AS (SELECT *, {_HAV} AS distance_km FROM (SELECT *, {_A.format(lat1="lat", lat2="latitude", lon1="lon", lon2="longitude")} AS a
    FROM cand, srch) WHERE {_HAV} <= radius_km)'''


def _search(spark, sf):
    size = shape(spark, sf)
    cand = checkpoint(global_rank(points(spark, sf, size), best_first()).select(
        "rank", "row", F.col("col").alias("column"), F.col("p").alias("score"), "longitude", "latitude"))
    number = F.col("row").cast("long") * size.width + F.col("column")
    srch = cand.filter(number % 50 == 0).select(
        number.alias("search_id"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"),
        (F.lit(0.5) + F.floor(number / 50) % 3).alias("radius_km"))
    return cand, srch


@query(sql('SELECT search_id, rank, "row", "column", score, round(distance_km, 6) AS distance_km FROM hits', "points", _SEARCHES, _HITS))
def radius_search(spark, sf):
    """Circles of 0.5 to 2.5 km around every 50th pixel, among all pixels."""
    cand, srch = _search(spark, sf)
    return six(S.radius_search(cand, srch).select("search_id", "rank", "row", "column", "score", "distance_km"), "distance_km")


@query(sql('''SELECT s.search_id, count(h.rank) AS nearby_count, round(min(h.distance_km), 6) AS nearest_km FROM srch s
    LEFT JOIN hits h ON h.search_id = s.search_id GROUP BY 1''', "points", _SEARCHES, _HITS))
def radius_search_summary(spark, sf):
    cand, srch = _search(spark, sf)
    return six(S.search_summary(S.radius_search(cand, srch), srch), "nearest_km")


@query(sql("""SELECT search_id, rank, distance_km FROM (SELECT search_id, rank, round(distance_km, 6) AS distance_km FROM hits)
    ORDER BY distance_km, rank, search_id LIMIT 150""", "points", _SEARCHES, _HITS))
def nearest_results(spark, sf):
    """The 150 nearest results; distances are rounded first so that both engines see the same ties."""
    hits = S.radius_search(*_search(spark, sf)).select("search_id", "rank", "distance_km")
    return S.sorted_results(six(hits, "distance_km"), "distance", 150)


@query(sql('SELECT search_id, rank, score FROM hits ORDER BY score DESC, rank, search_id LIMIT 25', "points", _SEARCHES, _HITS))
def best_results(spark, sf):
    hits = S.radius_search(*_search(spark, sf))
    return S.sorted_results(hits, "score", 25).select("search_id", "rank", "score")


@query(sql('SELECT search_id, rank, round(distance_km, 6) AS distance_km FROM hits ORDER BY rank, search_id LIMIT 25', "points", _SEARCHES, _HITS))
def ranked_results(spark, sf):
    hits = S.radius_search(*_search(spark, sf))
    return six(S.sorted_results(hits, "rank", 25).select("search_id", "rank", "distance_km"), "distance_km")


@query(sql('''SELECT rank, printf('%.6f', score) AS score, printf('%.4f', distance_km) AS distance_km, printf('%.6f', latitude) AS latitude,
    printf('%.6f', longitude) AS longitude, "row", "column" FROM hits''', "points", _SEARCHES.replace("p AS score", "sqrt(p) AS score"), _HITS))
def search_export_layout(spark, sf):
    cand, srch = _search(spark, sf)
    hits = S.radius_search(cand.withColumn("score", F.sqrt("score")), srch)
    return search_export(hits)


@query(sql('''SELECT lookup_id, rank, "row", "column" FROM (SELECT s.search_id AS lookup_id, c.*, row_number() OVER (PARTITION BY search_id ORDER BY rank) AS n
    FROM srch s JOIN cand c ON abs(s.lon + 4e-7 - c.longitude) < 1e-6 AND abs(s.lat - 4e-7 - c.latitude) < 1e-6) WHERE n = 1''', "points", _SEARCHES))
def coordinate_lookup(spark, sf):
    cand, srch = _search(spark, sf)
    wanted = srch.select(F.col("search_id").alias("lookup_id"), (F.col("lon") + 4e-7).alias("lon"), (F.col("lat") - 4e-7).alias("lat"))
    return S.coordinate_lookup(cand, wanted).select("lookup_id", "rank", "row", "column")


_RING = '''ring AS (SELECT search_id, CAST(i AS INTEGER) AS i, round(degrees(radians(lon) + atan2(sin(b) * sin(ad) * cos(radians(lat)), cos(ad) - sin(radians(lat)) * sin(lat2))), 6) AS longitude,
    round(degrees(lat2), 6) AS latitude FROM (SELECT *, asin(sin(radians(lat)) * cos(ad) + cos(radians(lat)) * sin(ad) * cos(b)) AS lat2 FROM (
      SELECT *, radius_km / 6371e0 AS ad, i / 128e0 * pi() * 2 AS b FROM srch, (SELECT unnest(range(129)) AS i))))'''


@query(sql("SELECT * FROM ring", "points", _SEARCHES, _RING))
def search_circles(spark, sf):
    _, srch = _search(spark, sf)
    return six(S.search_circle(srch), "longitude", "latitude")


@query(sql('''SELECT search_id, CAST(count(*) AS INTEGER) AS ring_points, max(longitude) FILTER (i = 0) = max(longitude) FILTER (i = 128)
    AND max(latitude) FILTER (i = 0) = max(latitude) FILTER (i = 128) AS closed, ''' + ", ".join(
    f"max({c}) FILTER (i = {i}) AS {c}_{i}" for i in (0, 32, 64, 96) for c in ("longitude", "latitude")) + " FROM ring GROUP BY 1", "points", _SEARCHES, _RING))
def search_circle_rings(spark, sf):
    """Closed rings in order: the corners of the compass and the number of points."""
    _, srch = _search(spark, sf)
    at = lambda i, k: F.round(F.col("ring")[i][k], 6)
    return S.circle_rings(S.search_circle(srch)).select(
        "search_id", F.size("ring").alias("ring_points"), ((at(0, 0) == at(128, 0)) & (at(0, 1) == at(128, 1))).alias("closed"),
        *[at(i, k).alias(f"{c}_{i}") for i in (0, 32, 64, 96) for k, c in enumerate(("longitude", "latitude"))])
