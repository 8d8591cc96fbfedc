"""Scans, profiles and sink layouts."""

from pyspark.sql import functions as F

from ..functions.geo import SURVEY_GEO
from ..operators import grid as G
from ..operators.ordering import best_first, top_k
from ..plans.candidates import candidate_table
from ..functions.values import error_class
from ..sources import tables as S
from ..session import shared_path
from . import query
from .fixtures import BANDS, GEO, bands, grid, grid2, shape, six, sql, sql_lonlat, union_all
from .thinning import thin_cte


@query(sql('SELECT "row", col, p, g FROM grid', "grid"))
def pixel_scan(spark, sf):
    return grid(spark, sf).select("row", "col", "p", "g")


@query(sql('''SELECT CAST("row" // 512 AS INTEGER) AS strip, count(*) AS n, min("row") AS first_row,
    max("row") AS last_row, round(avg(p), 6) AS mean_p FROM grid GROUP BY 1''', "grid"))
def strip_scan(spark, sf):
    return grid(spark, sf).groupBy(G.strip_of(512).alias("strip")).agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"),
        F.round(F.avg("p"), 6).alias("mean_p"))


_PROFILE = f'''SELECT CAST(max("row") + 1 AS INTEGER) AS height, CAST(max(col) + 1 AS INTEGER) AS width,
    5 AS bands, {GEO.left}e0 AS left_m, {GEO.top}e0 - (max("row") + 1) * {GEO.res}e0 AS bottom_m,
    {GEO.left}e0 + (max(col) + 1) * {GEO.res}e0 AS right_m, {GEO.top}e0 AS top_m,
    {GEO.res}e0 AS resolution, 'EPSG:32611' AS crs FROM '''


@query(sql(_PROFILE + "grid", "grid"))
def raster_profile(spark, sf):
    return G.raster_profile(grid(spark, sf), ["b1", "b2", "b3", "b4", "b5"], GEO)


@query(sql('''SELECT a.width = b.width AS same_width, a.height = b.height AS same_height,
    a.crs = b.crs AS same_crs, a.resolution = b.resolution AS same_resolution,
    a.left_m = b.left_m AND a.right_m = b.right_m AND a.top_m = b.top_m AND a.bottom_m = b.bottom_m AS same_bounds,
    a.left_m = b.left_m AND a.top_m = b.top_m AND a.resolution = b.resolution AS same_transform
    FROM a, b''', "grid", "grid2", f"a AS ({_PROFILE} grid)", f"b AS ({_PROFILE} grid2)"))
def raster_compatibility(spark, sf):
    size = shape(spark, sf)
    names = ["b1", "b2", "b3", "b4", "b5"]
    return G.compatible(G.raster_profile(grid(spark, sf, size), names, GEO),
                        G.raster_profile(grid2(spark, sf, size), names, GEO))


@query(sql(" UNION ALL ".join(f'''SELECT '{b}' AS band, min({b}) FILTER (valid) AS min, max({b}) FILTER (valid) AS max,
    round(avg({b}) FILTER (valid), 6) AS mean, count(*) FILTER (NOT valid OR {b} IS NULL) AS masked FROM bands''' for b in BANDS), "bands"))
def band_profile(spark, sf):
    b = bands(spark, sf)
    return six(union_all([G.band_profile(b, c, "valid").withColumn("band", F.lit(c)) for c in BANDS]), "mean")


@query(sql(" UNION ALL ".join(f'''(SELECT '{b}' AS band, {b} AS value, count(*) AS n FROM bands WHERE {b} IS NOT NULL
    GROUP BY 2 ORDER BY 2 LIMIT 20)''' for b in BANDS), "bands"))
def band_distinct_values(spark, sf):
    b = bands(spark, sf)
    return union_all([G.distinct_values(b, c).withColumn("band", F.lit(c)) for c in BANDS])


@query(sql('SELECT CAST(g AS INTEGER) AS value, count(*) AS n FROM grid GROUP BY 1', "grid"))
def label_value_counts(spark, sf):
    return grid(spark, sf).groupBy(F.col("g").alias("value")).agg(F.count(F.lit(1)).alias("n"))


_RANKED = ("grid", '''ranked AS (SELECT *, row_number() OVER (ORDER BY p DESC, "row" DESC, col DESC)
    AS rank FROM grid WHERE p > 0 AND valid)''')
# Every candidate of the thinned map.
_CANDIDATES = ("grid", "size", "inside AS (SELECT * FROM grid WHERE valid AND p > 0)", *thin_cte("inside", 1),
               f'''cut AS (SELECT thin_rank AS rank, "row", col, p, {GEO.left}e0 + (col + 0.5e0) * {GEO.res}e0 AS x,
                 {GEO.top}e0 - ("row" + 0.5e0) * {GEO.res}e0 AS y FROM picks)''', sql_lonlat("cut", "cand"))


def _candidates(spark, sf):
    size = shape(spark, sf)
    return candidate_table(grid(spark, sf, size), size.height * size.width, 0.001, 1, GEO, valid="valid")


@query(sql('''SELECT rank, "row", col AS "column", p AS raw_model_probability,
    round(pow(p, 0.001e0), 6) AS ranking_score, x, y, round(longitude, 6) AS longitude,
    round(latitude, 6) AS latitude FROM cand''', *_CANDIDATES, recursive=True))
def candidate_table_top(spark, sf):
    return six(_candidates(spark, sf), "ranking_score", "longitude", "latitude")


@query(sql('''SELECT rank, "row", col AS "column", printf('%.9f', p) AS raw_model_probability,
    printf('%.9f', pow(p, 0.001e0)) AS ranking_score, printf('%.3f', x) AS x, printf('%.3f', y) AS y,
    printf('%.8f', longitude) AS longitude, printf('%.8f', latitude) AS latitude FROM cand''', *_CANDIDATES, recursive=True))
def candidate_export(spark, sf):
    return S.candidate_export(_candidates(spark, sf))


@query(sql('''SELECT rank, "row", col AS "column", printf('%.8f', latitude) AS latitude,
    printf('%.8f', longitude) AS longitude, printf('%.8f', p) AS prediction FROM cand''', *_CANDIDATES, recursive=True))
def candidate_reduced_export(spark, sf):
    return S.reduced_export(_candidates(spark, sf))


@query(sql('''SELECT rank, "row", col AS "column", round(pow(p, 0.001e0), 6) AS score, x, y,
    round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM cand''', *_CANDIDATES, recursive=True))
def candidate_product_export(spark, sf):
    return six(S.product_export(_candidates(spark, sf)), "score", "longitude", "latitude")


@query(sql('''SELECT rank, "row", col AS "column", round(pow(p, 0.001e0), 6) AS score, x, y,
    round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM cand''', *_CANDIDATES, recursive=True))
def candidate_geojson_roundtrip(spark, sf):
    """Features written as GeoJSON text and read back through the fixed schema."""
    text = S.to_features(_candidates(spark, sf))
    parsed = text.select(F.array(F.from_json("feature", S.GEOJSON_SCHEMA["features"].dataType.elementType))
                         .alias("features"))
    return six(S.flatten_features(parsed), "score", "longitude", "latitude")


@query(sql('''SELECT g."row", g.col, coalesce(c.p, 0e0) AS p FROM grid g
    LEFT JOIN (SELECT * FROM ranked WHERE rank <= 500) c ON c."row" = g."row" AND c.col = g.col''',
           *_RANKED))
def grid_write_back(spark, sf):
    g = grid(spark, sf)
    return G.fill_grid(g, top_k(g.filter("valid and p > 0"), 500, best_first()))


@query(sql('''SELECT "row", col, p FROM grid WHERE p >= 0.8e0 AND g > 0''', "grid"))
def true_positive_points(spark, sf):
    return _points_of(spark, sf, 1)


@query(sql('''SELECT "row", col, p FROM grid WHERE p < 0.8e0 AND g > 0''', "grid"))
def false_negative_points(spark, sf):
    return _points_of(spark, sf, 3)


@query(sql('''SELECT "row", col, p FROM grid WHERE p >= 0.8e0 AND g = 0''', "grid"))
def false_positive_points(spark, sf):
    return _points_of(spark, sf, 2)


def _points_of(spark, sf, error: int):
    flagged = grid(spark, sf).withColumn("error", error_class(F.col("p") >= 0.8, F.col("g") > 0, F.lit(True)))
    return S.error_points(flagged, error, "p")


_HEADS = (20, 100, 500, 1000)


@query(sql(" UNION ALL ".join(f'''SELECT {n} AS head, rank, "row", col AS "column", p AS raw_model_probability FROM cand
    WHERE rank <= {n}''' for n in _HEADS), *_CANDIDATES, recursive=True))
def candidate_head(spark, sf):
    """The best 20, 100, 500 and 1,000 as exported; one sort serves all."""
    best = _candidates(spark, sf).orderBy("rank").limit(max(_HEADS))
    head = F.explode(F.array(*[F.lit(n) for n in _HEADS]))
    return (best.withColumn("head", head).filter(F.col("rank") <= F.col("head"))
            .select("head", "rank", "row", "column", "raw_model_probability"))


@query(sql('''SELECT CAST(rank AS INTEGER) AS rank, "row", col AS "column", CAST(printf('%.9f', p) AS DOUBLE) AS raw_model_probability,
    CAST(printf('%.9f', pow(p, 0.001e0)) AS DOUBLE) AS ranking_score, CAST(printf('%.3f', x) AS DOUBLE) AS x, CAST(printf('%.3f', y) AS DOUBLE) AS y,
    CAST(printf('%.8f', longitude) AS DOUBLE) AS longitude, CAST(printf('%.8f', latitude) AS DOUBLE) AS latitude FROM cand''', *_CANDIDATES, recursive=True))
def candidate_file_roundtrip(spark, sf):
    """The candidate CSV written, its columns checked, and read back with the fixed schema."""
    path = shared_path(spark, "candidates")
    S.write_csv(S.candidate_export(_candidates(spark, sf)), path)
    return S.read_candidates(spark, path)


@query(sql('''SELECT rank, "row", col AS "column", round(pow(p, 0.001e0), 6) AS score, x, y,
    round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM cand''', *_CANDIDATES, recursive=True))
def candidate_geojson_file(spark, sf):
    """FeatureCollections written as files and read back."""
    path = shared_path(spark, "geojson")
    S.write_geojson(_candidates(spark, sf), path)
    return six(S.read_geojson(spark, path, lines=True), "score", "longitude", "latitude")


@query(sql('''SELECT "row" // 32 AS strip, "row", col, p FROM grid, size WHERE "row" >= h // 64 * 32 AND "row" < h // 64 * 32 + 64''', "grid", "size"))
def strip_store(spark, sf):
    """The whole raster stored by strips of 32 rows; the two strips in its middle read back, the others pruned."""
    size = shape(spark, sf)
    path, first = shared_path(spark, "strips"), size.height // 64 * 32
    S.write_strips(grid(spark, sf, size).select("row", "col", "p"), path, 32)
    return S.read_strips(spark, path, first, first + 64, 32).select("strip", "row", "col", "p")


@query(sql('''SELECT CAST(g AS INTEGER) AS g, count(*) AS n, round(avg(p), 6) AS mean_p FROM grid GROUP BY 1''', "grid"))
def result_file_roundtrip(spark, sf):
    """An analysis table written as CSV in order and read back."""
    path = shared_path(spark, "result")
    table = grid(spark, sf).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))
    S.write_csv(table, path, ["g"])
    return spark.read.option("header", True).schema("g int, n long, mean_p double").csv(path)


@query(sql('''SELECT 'forest' AS model, 5 AS bands, max(h * wd) AS k, 0.001e0 AS power, 1 AS radius,
    count(*) AS selected FROM picks, size''', *_CANDIDATES, recursive=True))
def run_record(spark, sf):
    size = shape(spark, sf)
    return S.run_record(_candidates(spark, sf), model="forest", bands=5, k=size.height * size.width, power=0.001, radius=1)


@query(sql(f'''SELECT corner, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM c''',
           "grid", f"prof AS ({_PROFILE} grid)",
           '''k AS (SELECT 'top_left' AS corner, left_m AS x, top_m AS y FROM prof
    UNION ALL SELECT 'top_right', right_m, top_m FROM prof
    UNION ALL SELECT 'bottom_right', right_m, bottom_m FROM prof
    UNION ALL SELECT 'bottom_left', left_m, bottom_m FROM prof)''', sql_lonlat("k", "c")))
def raster_corners(spark, sf):
    return six(G.raster_corners(raster_profile(spark, sf), SURVEY_GEO), "longitude", "latitude")


@query(sql('''SELECT 'orders' AS source, 'EPSG:32611' AS source_crs, height, width,
    resolution AS res, 5 AS layer_count FROM prof''', "grid", f"prof AS ({_PROFILE} grid)"))
def layer_metadata(spark, sf):
    """Metadata JSON written and read back."""
    prof = raster_profile(spark, sf)
    layers = [(i, f"b{i}", f"band {i}") for i in range(1, 6)]
    text = S.layer_metadata(prof, G.raster_corners(prof, GEO), layers, "orders", GEO)
    parsed = text.select(F.from_json(
        "metadata", "source string, source_crs string, width int, height int, "
                    "resolution array<double>, layers array<struct<index:int,name:string>>").alias("m"))
    return parsed.select("m.source", "m.source_crs", "m.height", "m.width",
                         F.col("m.resolution")[0].alias("res"), F.size("m.layers").alias("layer_count"))
