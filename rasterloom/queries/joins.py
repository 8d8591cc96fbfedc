"""Pixel-keyed joins and set operations."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import grid as G
from ..operators import sampling as R
from . import query
from .fixtures import grid, grid2, shape, six, sql, table, truth


@query(sql('SELECT a."row", a.col, a.p AS p1, b.p AS p2 FROM grid a JOIN grid2 b ON a."row" = b."row" AND a.col = b.col', "grid", "grid2"))
def point_lookup(spark, sf):
    size = shape(spark, sf)
    return (grid2(spark, sf, size).select("row", "col", F.col("p").alias("p2"))
            .join(grid(spark, sf, size).select("row", "col", F.col("p").alias("p1")), ["row", "col"]))


@query(sql('''SELECT c."row", c.col, CAST(coalesce(l.g, 0) > 0 AS INTEGER) AS g FROM grid c
    LEFT JOIN grid2 l ON c."row" = l."row" AND c.col = l.col WHERE c.valid''', "grid", "grid2"))
def truth_at_coordinates(spark, sf):
    size = shape(spark, sf)
    labels = grid2(spark, sf, size).withColumnRenamed("g", "label")
    return G.truth_at(grid(spark, sf, size).filter("valid"), labels)


_BLOCK = '''CAST(least("row" // (h // 4), 3) * 4 + least(col // (wd // 4), 3) AS INTEGER)'''


@query(sql(f'''SELECT "row", col, p FROM grid, size WHERE p >= 0.9e0 AND {_BLOCK} IN (1, 7, 9, 10)''', "grid", "size"))
def candidates_in_validation(spark, sf):
    """Semi-join of candidates with the validation coordinate table."""
    size = shape(spark, sf)
    g = grid(spark, sf, size)
    inside = g.filter(G.block_of(size.height, size.width).isin(*G.VALIDATION_BLOCKS)).select("row", "col")
    return g.filter("p >= 0.9").select("row", "col", "p").join(inside, ["row", "col"], "left_semi")


@query(sql('SELECT "row", col, CASE WHEN valid THEN p ELSE 0e0 END AS p FROM grid', "grid"))
def masked_out(spark, sf):
    g = grid(spark, sf)
    return G.mask_out(g.select("row", "col", "p"), g.filter("valid"))


@query(sql('SELECT "row", col FROM grid WHERE g > 0 AND p < 0.8e0', "grid"))
def missed_truth(spark, sf):
    g = grid(spark, sf)
    return truth(spark, sf).join(g.filter("p >= 0.8").select("row", "col"), ["row", "col"], "left_anti")


@query(sql('''SELECT t."row", t.col, b.p AS score FROM truth t JOIN grid2 b ON t."row" = b."row" AND t.col = b.col''', "truth", "grid2"))
def score_lookup(spark, sf):
    size = shape(spark, sf)
    return truth(spark, sf, size).join(grid2(spark, sf, size).select("row", "col", F.col("p").alias("score")), ["row", "col"])


@query(sql('''SELECT e."row", e.col, e.p FROM grid2 e JOIN grid g ON e."row" = g."row" AND e.col = g.col, size
    WHERE e.p >= 0.3e0 AND g.valid AND g.g = 0 AND e."row" BETWEEN 15 AND h - 16 AND e.col BETWEEN 15 AND wd - 16''', "grid", "grid2", "size"))
def verified_negatives(spark, sf):
    """Mined pixels checked again against the pixel table."""
    size = shape(spark, sf)
    allowed = (grid(spark, sf, size).filter(F.col("valid") & (F.col("g") == 0) & G.border_safe(size.height, size.width))
               .select("row", "col"))
    return (grid2(spark, sf, size).filter("p >= 0.3").select("row", "col", "p")
            .join(allowed, ["row", "col"], "left_semi"))


@query(sql('''SELECT a."row", a.col, o.dy, o.dx, coalesce(b.p, 0e0) AS near FROM grid a
    CROSS JOIN (VALUES (-1, 0), (0, 1), (2, -2)) o(dy, dx)
    LEFT JOIN grid b ON b."row" = a."row" + o.dy AND b.col = a.col + o.dx''', "grid"))
def stencil_neighbours(spark, sf):
    return G.neighbour(grid(spark, sf), [(-1, 0), (0, 1), (2, -2)], "p")


@query(sql(f'''SELECT {_BLOCK} AS block_id, CASE WHEN {_BLOCK} IN (1, 7, 9, 10) THEN 'validation' ELSE 'train' END AS split,
    count(*) AS n, CAST(sum(g) AS BIGINT) AS n_truth FROM grid, size GROUP BY 1, 2''', "grid", "size"))
def spatial_blocks(spark, sf):
    size = shape(spark, sf)
    block = G.block_of(size.height, size.width)
    return (grid(spark, sf, size).withColumn("block_id", block)
            .groupBy("block_id", G.split_of(F.col("block_id")).alias("split"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("n_truth")))


@query(sql('''SELECT a."row", a.col, a.p AS a, 1 - a.p AS b FROM grid a''', "grid"))
def aligned_rasters(spark, sf):
    """Two rasters of one shape joined by pixel; a mismatch would fail the job."""
    g = grid(spark, sf)
    return E.aligned(g, g.withColumn("p", 1 - F.col("p")))


@query(sql('''SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS any_of,
    count(*) FILTER (a AND NOT b) AS only_a FROM (SELECT p >= 0.5e0 AS a, g > 0 AS b FROM grid)''', "grid"))
def mask_set_counts(spark, sf):
    a, b = F.col("p") >= 0.5, F.col("g") > 0
    return grid(spark, sf).agg(F.count(F.when(a & b, 1)).alias("both"), F.count(F.when(a | b, 1)).alias("any_of"),
                               F.count(F.when(a & ~b, 1)).alias("only_a"))


@query(sql('''SELECT "row", col FROM grid WHERE p >= 0.9e0 EXCEPT SELECT "row", col FROM grid2 WHERE p >= 0.1e0''', "grid", "grid2"))
def coordinate_difference(spark, sf):
    size = shape(spark, sf)
    a = grid(spark, sf, size).filter("p >= 0.9").select("row", "col")
    b = grid2(spark, sf, size).filter("p >= 0.1").select("row", "col")
    return a.join(b, ["row", "col"], "left_anti")


@query(sql('''SELECT "row", col, 'positive' AS part FROM grid WHERE g > 0 UNION ALL
    SELECT "row", col, 'hard' FROM grid WHERE g = 0 AND p >= 0.9e0 UNION ALL
    SELECT "row", col, 'moderate' FROM grid WHERE g = 0 AND p >= 0.7e0 AND p < 0.9e0''', "grid"))
def stacked_coordinates(spark, sf):
    g = grid(spark, sf)
    neg = g.filter("g = 0")
    parts = {"positive": g.filter("g > 0"), "hard": neg.filter("p >= 0.9"),
             "moderate": neg.filter("p >= 0.7 and p < 0.9")}
    from .fixtures import union_all
    return union_all([df.select("row", "col", F.lit(n).alias("part")) for n, df in parts.items()])


@query(sql('''SELECT CASE WHEN p >= 0.9e0 THEN '0.9+' WHEN p >= 0.8e0 THEN '0.8-0.9' WHEN p >= 0.7e0 THEN '0.7-0.8'
    WHEN p >= 0.6e0 THEN '0.6-0.7' END AS score_band, count(*) AS n FROM grid WHERE g = 0 GROUP BY 1''', "grid"))
def negative_score_bands(spark, sf):
    return (grid(spark, sf).filter("g = 0").groupBy(R.score_band(F.col("p")).alias("score_band"))
            .agg(F.count(F.lit(1)).alias("n")))
