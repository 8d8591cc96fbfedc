"""The flagship job in one query: scan, normalise, score tiles, average, mask, thin, cut to K, place."""

import pandas as pd
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import tiles as T
from ..plans.candidates import candidate_table
from . import query
from .cleaning import _STATS, _norm_sql
from .fixtures import BANDS, GEO, bands, shape, six, sql, sql_lonlat
from .focal import _IN_CORE, _IN_HALO, _TILES, REAL
from .thinning import thin_cte

TOP, POWER, RADIUS = 300, 5e-5, 1


def band_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stand-in model: half the pixel's own normalised bands plus half the tile's."""
    own = (0.5 + (pdf["b1"] + pdf["b2"] + pdf["b3"] + pdf["b4"] + pdf["b5"]) / 50).clip(0, 1)
    return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "p": own / 2 + own.mean() / 2})


@query(sql('''SELECT thin_rank AS rank, "row", col AS "column", p AS raw_model_probability, round(pow(p, 0.00005e0), 6) AS ranking_score,
    x, y, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM placed''',
           *_STATS, "size", _TILES.format(s=REAL["s"]),
           f'norm AS (SELECT "row", col, valid, {_norm_sql("valid", "greatest(s{i}, 1e-8)", "mean")} FROM bands, st)',
           'own AS MATERIALIZED (SELECT "row", col, valid, least(greatest(0.5e0 + (b1 + b2 + b3 + b4 + b5) / 50, 0e0), 1e0) AS p FROM norm)',
           f'''scored AS MATERIALIZED (SELECT "row", col, round(avg(p / 2 + m / 2), 9) AS p FROM own,
             (SELECT ty, tx, avg(p) AS m FROM own, tiles WHERE {_IN_HALO.format(**REAL)} GROUP BY 1, 2)
             WHERE valid AND {_IN_CORE.format(**REAL)} GROUP BY 1, 2)''',
           *thin_cte("scored", RADIUS),
           f'''cut AS (SELECT *, {GEO.left}e0 + (col + 0.5e0) * {GEO.res}e0 AS x,
             {GEO.top}e0 - ("row" + 0.5e0) * {GEO.res}e0 AS y FROM picks WHERE thin_rank <= {TOP})''',
           sql_lonlat("cut", "placed"), recursive=True))
def final_pipeline(spark, sf):
    size = shape(spark, sf)
    raw = bands(spark, sf, size)
    normal = G.normalize_bands(raw, BANDS, G.band_stats(raw, BANDS), valid="valid").withColumns(
        {b: F.round(b, 6) + F.lit(0.0) for b in BANDS})
    scored = T.score_tiles(normal.drop("p"), band_model, size.height, size.width, columns=BANDS, mask="valid")
    # Nine decimals: the order in which a tile mean is summed must not decide a rank.
    scored = scored.withColumn("p", F.round("p", 9))
    return six(candidate_table(scored, TOP, POWER, RADIUS, GEO), "ranking_score", "longitude", "latitude")
