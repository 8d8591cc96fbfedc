"""Sampling, balancing, splits and mining.  An arithmetic key stands in for the hash so SQL can follow."""

from pyspark.sql import functions as F

from ..functions.values import all_valid
from ..operators import grid as G
from ..operators import sampling as R
from . import query
from .fixtures import BANDS, bands, grid, shape, six, sql, truth
from .focal import _GAP, _RECTS

KEY = '(("row"::BIGINT * 73856093 + col::BIGINT * 19349663) % 1000003)'
_ORDER = f'(ORDER BY {KEY}, "row", col)'


def key():
    return (F.col("row").cast("long") * 73856093 + F.col("col").cast("long") * 19349663) % 1000003


def labelled(spark, sf, size=None):
    return grid(spark, sf, size).withColumnRenamed("g", "label")


@query(sql(f'SELECT "row", col FROM (SELECT *, row_number() OVER {_ORDER} AS n FROM grid WHERE g = 0) WHERE n <= 1500', "grid"))
def exact_sample(spark, sf):
    return R.sample_exact(grid(spark, sf).filter("g = 0").select("row", "col"), 1500, key())


@query(sql(f'SELECT "row", col, row_number() OVER {_ORDER} AS position FROM grid', "grid"))
def shuffled(spark, sf):
    return R.shuffle_order(grid(spark, sf).select("row", "col"), key())


@query(sql(f'''SELECT "row", col, g AS label FROM grid WHERE g > 0 UNION ALL SELECT "row", col, g FROM (
    SELECT *, row_number() OVER {_ORDER} AS n FROM grid WHERE g = 0) WHERE n <= (SELECT count(*) FROM truth)''', "truth"))
def balanced(spark, sf):
    return R.balance(labelled(spark, sf).select("row", "col", "label"), 1.0, key())


@query(sql(f'''SELECT "row", col, g AS label FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {KEY}, "row", col) AS n FROM grid WHERE valid)
    WHERE n <= (SELECT least(count(*) FILTER (g > 0), count(*) FILTER (g = 0)) FROM grid WHERE valid)''', "grid"))
def balanced_symmetric(spark, sf):
    return R.balance_symmetric(labelled(spark, sf).filter("valid").select("row", "col", "label"), key())


@query(sql(f'''SELECT "row", col, g AS label, CASE WHEN n <= ceil(total * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY {KEY}, "row", col) AS n, count(*) OVER (PARTITION BY g) AS total FROM grid)''', "grid"))
def stratified_split(spark, sf):
    return R.split_fraction(labelled(spark, sf).select("row", "col", "label"), "label", 0.2, key())


@query(sql(f'''SELECT "row", col, block_id, split FROM (SELECT *, CAST(least("row" // (h // 4), 3) * 4 + least(col // (wd // 4), 3) AS INTEGER) AS block_id,
    CASE WHEN least("row" // (h // 4), 3) * 4 + least(col // (wd // 4), 3) IN (1, 7, 9, 10) THEN 'validation' ELSE 'train' END AS split
    FROM bands, size WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AND b4 IS NOT NULL AND b5 IS NOT NULL
      AND "row" BETWEEN 15 AND h - 16 AND col BETWEEN 15 AND wd - 16) a
    WHERE (SELECT min({_GAP}) FROM blocks WHERE (b IN (1, 7, 9, 10)) <> (a.split = 'validation')) > 15''', "bands", "size", _RECTS))
def leak_safe_split(spark, sf):
    size = shape(spark, sf)
    out = R.leak_safe(bands(spark, sf, size), size.height, size.width, all_valid(BANDS))
    return out.select("row", "col", "block_id", "split")


# Confident truth alone counts as truth, so that pixels far from any remain on the test raster.
_MINED = f'''rare AS (SELECT "row", col FROM grid WHERE g > 0 AND p >= 0.9e0),
  mined AS (SELECT a."row", a.col, a.p FROM grid a, size WHERE NOT (a.g > 0 AND a.p >= 0.9e0) AND a.valid AND a.p >= 0.3e0
    AND a."row" BETWEEN 15 AND h - 16 AND a.col BETWEEN 15 AND wd - 16
    AND least(a."row" // (h // 4), 3) * 4 + least(a.col // (wd // 4), 3) NOT IN (1, 7, 9, 10)
    AND (SELECT min({_GAP.replace('"row"', 'a."row"').replace('col,', 'a.col,').replace(', col', ', a.col').replace('- col', '- a.col')}) FROM blocks WHERE b IN (1, 7, 9, 10)) > 15
    AND NOT EXISTS (SELECT 1 FROM rare t WHERE t."row" BETWEEN a."row" - 5 AND a."row" + 5 AND t.col BETWEEN a.col - 5 AND a.col + 5
      AND (t."row" - a."row") * (t."row" - a."row") + (t.col - a.col) * (t.col - a.col) < 25))'''


@query(sql('SELECT "row", col, p FROM mined ORDER BY p DESC, "row" DESC, col DESC LIMIT 100000', "grid", "size", _RECTS, _MINED))
def hard_negatives(spark, sf):
    """Best 100,000, more than 15 px from edges and validation and at least 5 px from truth."""
    size = shape(spark, sf)
    label = ((F.col("g") > 0) & (F.col("p") >= 0.9)).cast("int").alias("label")
    return R.hard_negatives(grid(spark, sf, size).select("row", "col", "p", "valid", label), size.height, size.width)


@query(sql('''SELECT a."row", a.col, round(sqrt(min((t."row" - a."row") * (t."row" - a."row") + (t.col - a.col) * (t.col - a.col))::DOUBLE), 6) AS truth_distance
    FROM grid a JOIN truth t ON t."row" BETWEEN a."row" - 3 AND a."row" + 3 AND t.col BETWEEN a.col - 3 AND a.col + 3
    WHERE a.g = 0 AND (t."row" - a."row") * (t."row" - a."row") + (t.col - a.col) * (t.col - a.col) <= 9 GROUP BY 1, 2''', "truth"))
def near_negatives(spark, sf):
    size = shape(spark, sf)
    out = R.near_negatives(labelled(spark, sf, size).select("row", "col", "label"), truth(spark, sf, size))
    return six(out.select("row", "col", "truth_distance"), "truth_distance")


_STRATUM = "CASE WHEN g > 0 THEN 'positive' WHEN p >= 0.9e0 THEN 'hard' WHEN p >= 0.7e0 THEN 'moderate' ELSE 'ordinary' END"
QUOTAS = {"positive": 900, "ordinary": 900, "hard": 450, "moderate": 450}


@query(sql(f'''SELECT "row", col, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {KEY}, "row", col) AS n
    FROM (SELECT *, {_STRATUM} AS stratum FROM grid)) WHERE n <= CASE stratum WHEN 'positive' THEN 900 WHEN 'ordinary' THEN 900 ELSE 450 END''', "grid"))
def stratified_training_set(spark, sf):
    p = F.col("p")
    stratum = (F.when(F.col("g") > 0, "positive").when(p >= 0.9, "hard").when(p >= 0.7, "moderate").otherwise("ordinary"))
    return R.stratified(grid(spark, sf).select("row", "col", stratum.alias("stratum")), "stratum", QUOTAS, key())


@query(sql(f'''SELECT "row", col, part FROM (SELECT "row", col, 'base' AS part FROM grid WHERE g > 0
    UNION ALL SELECT "row", col, 'added' FROM (SELECT *, row_number() OVER {_ORDER} AS n FROM grid WHERE g = 0 AND p >= 0.8e0) WHERE n <= 700)''', "grid"))
def appended_hard_negatives(spark, sf):
    """Base set plus an exact number of hard negatives; too few would raise."""
    g = grid(spark, sf)
    hard = g.filter("g = 0 and p >= 0.8").select("row", "col", F.lit("added").alias("part"))
    added = R.stratified(hard, "part", {"added": 700}, key(), strict=True)
    return g.filter("g > 0").select("row", "col", F.lit("base").alias("part")).unionByName(added)


@query(sql('''SELECT least("row" // (h // 4), 3) * 4 + least(col // (wd // 4), 3) IN ({ids}) AS held_out, count(*) AS n
    FROM grid, size GROUP BY 1'''.replace("{ids}", ", ".join(map(str, R.random_blocks()))), "grid", "size"))
def random_block_split(spark, sf):
    size = shape(spark, sf)
    held = G.block_of(size.height, size.width).isin(*R.random_blocks())
    return grid(spark, sf, size).groupBy(held.alias("held_out")).agg(F.count(F.lit(1)).alias("n"))
