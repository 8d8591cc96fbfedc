"""Neighbourhood, tile and patch queries."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions.kernels import box, disc, linear_kernel, weighted_disc
from ..operators import evaluation as E
from ..operators import grid as G
from ..operators import metric as M
from ..operators import sampling as R
from ..operators import tiles as T
from . import query
from .fixtures import BANDS, bands, grid, shape, six, sql, truth, values_offsets

_K = values_offsets(weighted_disc(3, linear_kernel(3)))


@query(sql('''SELECT "row" + dy AS "row", col + dx AS col, round(max(k), 6) AS influence FROM truth CROSS JOIN o GROUP BY 1, 2''', "truth", _K))
def truth_influence(spark, sf):
    """Kernel maximum spread from the sparse truth side."""
    return six(M.influence(truth(spark, sf)), "influence")


@query(sql('''SELECT a."row", a.col, round(max(b.p * k), 6) AS best FROM grid a CROSS JOIN o
    JOIN grid b ON b."row" = a."row" + dy AND b.col = a.col + dx GROUP BY 1, 2''', "grid", _K))
def kernel_maximum(spark, sf):
    """Dense kernel maximum, tile-parallel."""
    out = T.focal(grid(spark, sf), "p", how="maxw", name="best",
                  offsets=weighted_disc(3, linear_kernel(3)), tile=64)
    return six(out, "best")


@query(sql('''SELECT a."row", a.col, CAST(max(b.g) AS DOUBLE) AS reached FROM grid a JOIN grid b
    ON b."row" BETWEEN a."row" - 3 AND a."row" + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 GROUP BY 1, 2''', "grid"))
def square_dilation(spark, sf):
    return T.focal(grid(spark, sf), "g", how="max", box=3, name="reached", tile=64)


@query(sql('''SELECT r AS within_px, count(*) FILTER (d <= r) AS n, round(count(*) FILTER (d <= r) / count(*)::DOUBLE, 6) AS share FROM (
    SELECT a."row", a.col, min(greatest(abs(t."row" - a."row"), abs(t.col - a.col))) AS d FROM grid a LEFT JOIN truth t
      ON t."row" BETWEEN a."row" - 10 AND a."row" + 10 AND t.col BETWEEN a.col - 10 AND a.col + 10
    WHERE a.p >= 0.9e0 AND a.g = 0 GROUP BY 1, 2), (VALUES (1), (3), (5), (10)) v(r) GROUP BY 1''', "grid", "truth"))
def false_positives_near_truth(spark, sf):
    size = shape(spark, sf)
    wrong = grid(spark, sf, size).filter("p >= 0.9 and g = 0").select("row", "col")
    return six(E.chebyshev_shares(wrong, truth(spark, sf, size), [1, 3, 5, 10]), "share")


_D5 = values_offsets([(dy, dx, d) for dy, dx, d in disc(5)])


@query(sql('''SELECT a."row", a.col, round(min(k), 6) AS truth_distance FROM grid a CROSS JOIN o
    LEFT JOIN truth t ON t."row" = a."row" + dy AND t.col = a.col + dx
    GROUP BY 1, 2 HAVING true'''.replace("min(k)", 'min(CASE WHEN t."row" IS NOT NULL THEN k END)'), "grid", "truth", _D5))
def bounded_truth_distance(spark, sf):
    size = shape(spark, sf)
    out = R.distance_to_truth(grid(spark, sf, size).select("row", "col"), truth(spark, sf, size), 5)
    return six(out, "truth_distance")


@query(sql('''SELECT a."row", a.col, round(min(CASE WHEN b.p >= 0.98e0 THEN k END), 6) AS d FROM grid a CROSS JOIN o
    LEFT JOIN grid b ON b."row" = a."row" + dy AND b.col = a.col + dx GROUP BY 1, 2''', "grid",
           values_offsets([(dy, dx, d) for dy, dx, d in disc(8)])))
def dense_mask_distance(spark, sf):
    """Distance to a mask on the dense grid, tile-parallel."""
    g = grid(spark, sf).withColumn("m", (F.col("p") >= 0.98).cast("int"))
    return six(T.focal(g, "m", how="dist", offsets=disc(8), name="d", tile=64), "d")


_RECTS = '''blocks AS (SELECT ry * 4 + bx AS b, ry * (h // 4) AS r0, CASE WHEN ry = 3 THEN h ELSE (ry + 1) * (h // 4) END - 1 AS r1,
    bx * (wd // 4) AS c0, CASE WHEN bx = 3 THEN wd ELSE (bx + 1) * (wd // 4) END - 1 AS c1
    FROM size, (SELECT unnest(range(4)) AS ry), (SELECT unnest(range(4)) AS bx))'''
_GAP = '''sqrt(pow(greatest(r0 - "row", "row" - r1, 0), 2e0) + pow(greatest(c0 - col, col - c1, 0), 2e0))'''


@query(sql(f'''SELECT "row", col, round(min({_GAP}), 6) AS d FROM grid, blocks WHERE b IN (1, 7, 9, 10) GROUP BY 1, 2''', "grid", "size", _RECTS))
def distance_to_validation(spark, sf):
    size = shape(spark, sf)
    out = G.with_split_distance(grid(spark, sf, size).select("row", "col"), size.height, size.width,
                                G.VALIDATION_BLOCKS, "d")
    return six(out, "d")


@query(sql('''SELECT a."row", a.col, round(sum(CASE WHEN b.p >= 0.8e0 AND b.g = 0 THEN 1e0 ELSE 0e0 END) / 961e0, 6) AS density FROM grid a
    JOIN grid b ON b."row" BETWEEN a."row" - 15 AND a."row" + 15 AND b.col BETWEEN a.col - 15 AND a.col + 15 GROUP BY 1, 2''', "grid"))
def error_density(spark, sf):
    """31x31 box mean of false positives, zero outside the raster."""
    size = shape(spark, sf)
    wrong = grid(spark, sf, size).withColumn("fp", ((F.col("p") >= 0.8) & (F.col("g") == 0)).cast("int"))
    out = T.focal(wrong, "fp", how="sum", box=15, name="n")
    return out.select("row", "col", F.round(F.col("n") / 961, 6).alias("density"))


_STAMP = values_offsets(weighted_disc(3, linear_kernel(4)))


@query(sql('''SELECT "row" + dy AS "row", col + dx AS col, round(max(k), 6) AS target FROM truth CROSS JOIN o GROUP BY 1, 2''', "truth", _STAMP))
def soft_targets(spark, sf):
    stamp = M.truth_reach(truth(spark, sf), weighted_disc(3, linear_kernel(4)))
    return six(stamp.withColumnRenamed("influence", "target"), "target")


_TILES = '''tiles AS (SELECT ty, tx FROM (SELECT unnest(range(CAST((h + {s} - 1) // {s} AS BIGINT))) AS ty FROM size),
    (SELECT unnest(range(CAST((wd + {s} - 1) // {s} AS BIGINT))) AS tx FROM size))'''
_IN_HALO = '''"row" >= ty * {s} - {h} AND "row" < ty * {s} + {c} + {h} AND col >= tx * {s} - {h} AND col < tx * {s} + {c} + {h}'''
_IN_CORE = '''"row" >= ty * {s} AND "row" < ty * {s} + {c} AND col >= tx * {s} AND col < tx * {s} + {c}'''
#: Core, step and halo of the small tiles, of which the test raster holds many, and of the real ones.
SMALL, REAL = dict(c=32, s=28, h=3), dict(c=256, s=224, h=15)


def _tiling_sql(c: int, s: int, h: int) -> str:
    at = dict(c=c, s=s, h=h)
    return sql(f'''SELECT CAST(ty AS INTEGER) AS tile_y, CAST(tx AS INTEGER) AS tile_x, count(*) AS n_read,
        count(*) FILTER ({_IN_CORE.format(**at)}) AS n_core FROM grid, tiles WHERE {_IN_HALO.format(**at)} GROUP BY 1, 2''',
               "grid", "size", _TILES.format(s=s))


def _tiling(spark, sf, c: int, s: int, h: int):
    size = shape(spark, sf)
    return (T.halo_tiling(grid(spark, sf, size), size.height, size.width, core=c, step=s, halo=h)
            .groupBy("tile_y", "tile_x").agg(F.count(F.lit(1)).alias("n_read"), F.count(F.when(F.col("in_core"), 1)).alias("n_core")))


@query(_tiling_sql(**SMALL))
def overlapping_tiles(spark, sf):
    return _tiling(spark, sf, **SMALL)


@query(_tiling_sql(**REAL))
def overlapping_tiles_real(spark, sf):
    return _tiling(spark, sf, **REAL)


@query(_tiling_sql(c=32, s=32, h=3))
def disjoint_tiles(spark, sf):
    return _tiling(spark, sf, 32, 32, 3)


def tile_mean(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stand-in model: half the pixel's own p plus half the tile mean."""
    return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "p": pdf["p"] / 2 + pdf["p"].mean() / 2})


def _scoring_sql(c: int, s: int, h: int) -> str:
    at = dict(c=c, s=s, h=h)
    return sql(f'''SELECT g."row", g.col, round(CASE WHEN g.valid THEN s.p ELSE 0e0 END, 6) AS p FROM grid g JOIN (
    SELECT "row", col, avg(p / 2 + m / 2) AS p FROM grid, (SELECT ty, tx, avg(p) AS m FROM grid, tiles
      WHERE {_IN_HALO.format(**at)} GROUP BY 1, 2) WHERE {_IN_CORE.format(**at)} GROUP BY 1, 2) s
    ON s."row" = g."row" AND s.col = g.col''', "grid", "size", _TILES.format(s=s))


def _scoring(spark, sf, c: int, s: int, h: int):
    size = shape(spark, sf)
    out = T.score_tiles(grid(spark, sf, size), tile_mean, size.height, size.width, columns=["p"],
                        core=c, step=s, halo=h, mask="valid")
    return six(out, "p")


@query(_scoring_sql(**REAL))
def tile_scoring(spark, sf):
    """User scorer on halo tiles, core pixels kept, overlaps averaged, mask applied."""
    return _scoring(spark, sf, **REAL)


@query(_scoring_sql(**SMALL))
def tile_scoring_small(spark, sf):
    return _scoring(spark, sf, **SMALL)


@query(sql('''SELECT a."row", a.col, o.dy, o.dx, b.p FROM grid a CROSS JOIN
    (SELECT dy, dx FROM (SELECT unnest(range(-2, 3))::INTEGER AS dy), (SELECT unnest(range(-2, 3))::INTEGER AS dx)) o, size
    JOIN grid b ON b."row" = least(greatest(a."row" + o.dy, 0), h - 1) AND b.col = least(greatest(a.col + o.dx, 0), wd - 1)
    WHERE a.g > 0'''.replace("CROSS JOIN\n    (SELECT dy", "CROSS JOIN size CROSS JOIN\n    (SELECT dy").replace(") o, size\n", ") o\n"), "grid", "size"))
def edge_padded_windows(spark, sf):
    size = shape(spark, sf)
    g = grid(spark, sf, size)
    out = T.edge_padded(g.select("row", "col", "p"), g.filter("g > 0"), 2, size.height, size.width)
    return out.select(F.col("c_row").alias("row"), F.col("c_col").alias("col"), "dy", "dx", "p")


@query(sql('''SELECT a."row", a.col, count(*) AS cells, round(sum(b.p), 8) AS total, min(b.p) AS low, max(b.p) AS high FROM truth a
    CROSS JOIN size CROSS JOIN (SELECT dy, dx FROM (SELECT unnest(range(-4, 5))::INTEGER AS dy), (SELECT unnest(range(-4, 5))::INTEGER AS dx)) o
    JOIN grid b ON b."row" = least(greatest(a."row" + o.dy, 0), h - 1) AND b.col = least(greatest(a.col + o.dx, 0), wd - 1)
    GROUP BY 1, 2''', "grid", "truth", "size"))
def edge_padded_patches(spark, sf):
    """9x9 patches around every truth pixel, border cells repeated outwards."""
    size = shape(spark, sf)
    cut = T.patches(grid(spark, sf, size), truth(spark, sf, size), 4, ["p"], "edge", (size.height, size.width))
    return _patch_summary(cut)


def _patch_summary(cut):
    return cut.select(
        "row", "col", F.size("p").cast("long").alias("cells"),
        F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 8).alias("total"),
        F.array_min("p").alias("low"), F.array_max("p").alias("high"))


_CENTRES = '''SELECT a."row", a.col, count(*) AS cells, {agg} FROM truth a JOIN grid b ON b."row" BETWEEN a."row" - 15 AND a."row" + 15
    AND b.col BETWEEN a.col - 15 AND a.col + 15 GROUP BY 1, 2 HAVING count(*) = 961'''


def _patches(spark, sf):
    size = shape(spark, sf)
    return T.patches(grid(spark, sf, size), truth(spark, sf, size), 15, ["p"], on_border="skip")


@query(sql(_CENTRES.format(agg='''round(sum(b.p), 8) AS total, min(b.p) AS low, max(b.p) AS high'''), "grid", "truth"))
def patch_extraction(spark, sf):
    """31x31 patches around truth pixels; incomplete ones are skipped."""
    return _patch_summary(_patches(spark, sf))


@query(sql('SELECT "row", col, round(centre_mean, 6) AS centre_mean FROM (' + _CENTRES.format(
    agg='avg(b.p) FILTER (abs(b."row" - a."row") <= 2 AND abs(b.col - a.col) <= 2) AS centre_mean') + ")", "grid", "truth"))
def patch_centre_mean(spark, sf):
    return six(T.centre_mean(_patches(spark, sf), "p", 15), "centre_mean")


def _patch_model(pdf: pd.DataFrame) -> pd.Series:
    return pdf["p"].map(lambda cells: cells.mean())


@query(sql('SELECT "row", col, round(p, 6) AS p FROM (' + _CENTRES.format(agg="avg(b.p) AS p") + ")", "grid", "truth"))
def patch_scoring(spark, sf):
    """User scorer over patches in Arrow batches."""
    return six(T.score_patches(_patches(spark, sf), _patch_model), "p")


@query(sql('''SELECT "row", col, round(avg(p), 6) AS p FROM (SELECT "row", col, sqrt(p) AS p FROM grid UNION ALL
    SELECT "row", col, p * sqrt(p) FROM grid WHERE valid) GROUP BY 1, 2''', "grid"))
def overlap_average(spark, sf):
    g = grid(spark, sf)
    both = g.select("row", "col", F.sqrt("p").alias("p")).unionByName(
        g.filter("valid").select("row", "col", (F.col("p") * F.sqrt("p")).alias("p")))
    return six(T.overlap_average(both), "p")


_N24 = ", ".join(f"({dy}, {dx})" for dy, dx, _ in box(1))


@query(sql('SELECT a."row", a.col, ' + ", ".join(f"min(b.{b}) AS {b}_low, max(b.{b}) AS {b}_high, round(coalesce(sum(b.{b}), 0e0), 6) AS {b}_total" for b in BANDS)
           + f''' FROM bands a CROSS JOIN (VALUES {_N24}) v(dy, dx) LEFT JOIN bands b ON b."row" = a."row" + dy AND b.col = a.col + dx GROUP BY 1, 2''', "bands"))
def focal_statistics(spark, sf):
    """3x3 minimum, maximum and sum of every band with NoData, in one tile pass."""
    return six(T.box_statistics(bands(spark, sf), BANDS, 1, tile=64), *[f"{b}_total" for b in BANDS])
