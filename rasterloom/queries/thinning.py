"""Greedy thinning, components and density clusters; the oracles iterate with recursive CTEs."""

from pyspark.sql import functions as F

from ..functions.kernels import disc
from ..operators import components as C
from ..operators import thinning as N
from ..operators.features import summary
from ..operators.grid import mask_out
from ..operators.ordering import best_first, global_rank
from ..plans.candidates import candidate_table
from . import query
from .fixtures import GEO, grid, points, shape, six, sql, sql_lonlat, values_offsets

ORDER = '(ORDER BY p DESC, "row" DESC, col DESC)'


def thin_cte(source: str, radius: int, name: str = "picks") -> list[str]:
    """The sequential visit as a recursive CTE: take the best pixel left, drop its window, repeat."""
    if radius == 0:
        return [f'{name} AS (SELECT "row", col, p, row_number() OVER {ORDER} AS thin_rank FROM {source})']
    r = 2 * radius
    return [
        f'{name}_pts AS MATERIALIZED (SELECT row_number() OVER {ORDER} AS id, "row", col, p FROM {source})',
        f'''{name}_walk(step, id, "row", col, p) AS (SELECT 0, id, "row", col, p FROM {name}_pts
          UNION ALL SELECT w.step + 1, w.id, w."row", w.col, w.p FROM {name}_walk w,
            (SELECT "row" AS pr, col AS pc FROM {name}_walk ORDER BY id LIMIT 1) b
          WHERE abs(w."row" - pr) > {r} OR abs(w.col - pc) > {r})''',
        f'''{name} AS (SELECT min_by("row", id) AS "row", min_by(col, id) AS col, max(p) AS p,
          CAST(step + 1 AS BIGINT) AS thin_rank FROM {name}_walk GROUP BY step)''']


_OUT = 'SELECT "row", col, p, thin_rank FROM picks'


@query(sql(_OUT, "grid", *thin_cte("grid", 1), recursive=True))
def spatial_thinning(spark, sf):
    return N.thin(grid(spark, sf), 1)


@query(sql(_OUT, "grid", *thin_cte("grid", 2), recursive=True))
def spatial_thinning_wide(spark, sf):
    return N.thin(grid(spark, sf), 2)


@query(sql(_OUT + " WHERE thin_rank <= 300", "grid", *thin_cte("grid", 1), recursive=True))
def spatial_thinning_first_k(spark, sf):
    return N.thin(grid(spark, sf), 1, 300)


@query(sql(_OUT, "grid", f'best AS (SELECT * FROM grid ORDER BY p DESC, "row" DESC, col DESC LIMIT 1000)',
           *thin_cte("best", 1), recursive=True))
def cut_then_thin(spark, sf):
    return N.cut_then_thin(grid(spark, sf), 1, 1000)


@query(sql('''SELECT thin_rank AS rank, "row", col AS "column", p AS raw_model_probability,
    round(pow(p, 0.001e0), 6) AS ranking_score, x, y, round(longitude, 6) AS longitude,
    round(latitude, 6) AS latitude FROM placed''', "grid", "inside AS (SELECT * FROM grid WHERE valid AND p > 0)",
           *thin_cte("inside", 1), f'''cut AS (SELECT *, {GEO.left}e0 + (col + 0.5e0) * {GEO.res}e0 AS x,
        {GEO.top}e0 - ("row" + 0.5e0) * {GEO.res}e0 AS y FROM picks WHERE thin_rank <= 500)''',
           sql_lonlat("cut", "placed"), recursive=True))
def candidate_creation(spark, sf):
    """Mask, positive, power, thin, cut, place: the whole candidate job."""
    out = candidate_table(grid(spark, sf), 500, 0.001, 1, GEO, valid="valid")
    return six(out, "ranking_score", "longitude", "latitude")


def component_cte(source: str, edges: str, key: str, name: str = "comp") -> list[str]:
    """Minimum-label propagation over an edge query (a, b)."""
    return [f"{name}_edges AS MATERIALIZED ({edges})",
            f'''{name}(id, root) USING KEY (id) AS (SELECT {key} AS id, {key} AS root FROM {source}
          UNION (SELECT x.id, min(y.root) AS root FROM recurring.{name} x JOIN {name}_edges e ON e.a = x.id
            JOIN recurring.{name} y ON y.id = e.b GROUP BY x.id, x.root HAVING min(y.root) < x.root))''']


_KEY = '("row"::BIGINT * 100000 + col)'
_EIGHT = ", ".join(f"({dy}, {dx})" for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0))
_MASK_EDGES = f'''SELECT a."row"::BIGINT * 100000 + a.col AS a, b."row"::BIGINT * 100000 + b.col AS b
    FROM mask a CROSS JOIN (VALUES {_EIGHT}) v(dy, dx) JOIN mask b ON b."row" = a."row" + dy AND b.col = a.col + dx'''


@query(sql('''SELECT CAST(id // 100000 AS INTEGER) AS "row", CAST(id % 100000 AS INTEGER) AS col,
    CAST(root // 100000 AS INTEGER) AS first_row, CAST(root % 100000 AS INTEGER) AS first_col FROM comp''',
           "grid", 'mask AS (SELECT "row", col FROM grid WHERE p >= 0.7e0)', *component_cte("mask", _MASK_EDGES, _KEY),
           recursive=True))
def connected_components(spark, sf):
    """8-connected pixels of the thresholded map, named by their first pixel."""
    out = C.connected_components(grid(spark, sf).filter("p >= 0.7"), tile=32)
    return out.select("row", "col", F.shiftright("root", 31).cast("int").alias("first_row"),
                      F.col("root").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("first_col"))


@query(sql('''SELECT CAST(row_number() OVER (ORDER BY size DESC, root) AS INTEGER) AS size_rank, CAST(root // 100000 AS INTEGER) AS first_row,
    CAST(root % 100000 AS INTEGER) AS first_col, size FROM (SELECT root, count(*) AS size FROM comp GROUP BY 1
      ORDER BY size DESC, root LIMIT 20)''',
           "grid", 'mask AS (SELECT "row", col FROM grid WHERE p >= 0.7e0)', *component_cte("mask", _MASK_EDGES, _KEY),
           recursive=True))
def component_sizes(spark, sf):
    return C.component_sizes(C.connected_components(grid(spark, sf).filter("p >= 0.7")))


EPS_M, MIN_SAMPLES = 300.0, 5
_NEAR = ", ".join(f"({dy}, {dx})" for dy, dx, _ in disc(3))
_DBSCAN = [
    f'cand AS MATERIALIZED (SELECT row_number() OVER {ORDER} AS rank, * FROM points WHERE p >= 0.85e0)',
    f'''pairs AS MATERIALIZED (SELECT a.rank AS a, b.rank AS b FROM cand a CROSS JOIN (VALUES {_NEAR}) v(dy, dx)
      JOIN cand b ON b."row" = a."row" + dy AND b.col = a.col + dx)''',
    f"core AS MATERIALIZED (SELECT a AS rank FROM pairs GROUP BY 1 HAVING count(*) >= {MIN_SAMPLES})",
    *component_cte("core", "SELECT a, b FROM pairs WHERE a IN (SELECT rank FROM core) AND b IN (SELECT rank FROM core) AND a <> b", "rank"),
    "numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM comp)",
    '''labelled AS (SELECT c.*, n.id IS NOT NULL AS is_core,
      CAST(coalesce(n.cid, (SELECT min(m.cid) FROM pairs q JOIN numbered m ON m.id = q.b WHERE q.a = c.rank), -1) AS BIGINT) AS cluster_id
      FROM cand c LEFT JOIN numbered n ON n.id = c.rank)''']


def clustered(spark, sf):
    cand = global_rank(points(spark, sf).filter("p >= 0.85"), best_first())
    ids = C.dbscan(cand, EPS_M, MIN_SAMPLES, GEO.res)
    return cand.join(ids, ["row", "col"])


@query(sql('SELECT "row", col, rank, is_core, cluster_id FROM labelled', "points", *_DBSCAN, recursive=True))
def density_clusters(spark, sf):
    return clustered(spark, sf).select("row", "col", "rank", "is_core", "cluster_id")


_SUMMARY_COLS = ["mean_probability", "median_probability", "max_probability", "p90_probability", "p95_probability",
                 "center_x_m", "center_y_m", "center_longitude", "center_latitude", "approx_bbox_area_km2"]


@query(sql('''SELECT cluster_id, count(*) AS candidate_count, round(avg(p), 6) AS mean_probability,
    round(quantile_cont(p, 0.5), 6) AS median_probability, round(max(p), 6) AS max_probability,
    round(quantile_cont(p, 0.9), 6) AS p90_probability, round(quantile_cont(p, 0.95), 6) AS p95_probability,
    round(avg(x), 6) AS center_x_m, round(avg(y), 6) AS center_y_m, round(avg(longitude), 6) AS center_longitude,
    round(avg(latitude), 6) AS center_latitude, min(x) AS min_x_m, max(x) AS max_x_m, min(y) AS min_y_m, max(y) AS max_y_m,
    max(x) - min(x) AS width_m, max(y) - min(y) AS height_m,
    round((max(x) - min(x)) * (max(y) - min(y)) / 1000000e0, 6) AS approx_bbox_area_km2
    FROM labelled WHERE cluster_id >= 0 GROUP BY 1''', "points", *_DBSCAN, recursive=True))
def cluster_summary(spark, sf):
    return six(C.cluster_summary(clustered(spark, sf)), *_SUMMARY_COLS)


@query(sql('''SELECT cluster_id, rank, "row", col, p FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id
    ORDER BY p DESC, rank) AS n FROM labelled WHERE cluster_id >= 0) WHERE n = 1''', "points", *_DBSCAN, recursive=True))
def cluster_best_member(spark, sf):
    return C.cluster_best(clustered(spark, sf))


@query(sql('''SELECT CAST(sum(n) FILTER (cluster_id >= 0) AS BIGINT) AS clustered, coalesce(CAST(sum(n) FILTER (cluster_id < 0) AS BIGINT), 0) AS noise,
    count(*) FILTER (cluster_id >= 0) AS clusters, min(n) FILTER (cluster_id >= 0) AS smallest,
    max(n) FILTER (cluster_id >= 0) AS largest, round(avg(n) FILTER (cluster_id >= 0), 6) AS mean_size,
    round(quantile_cont(n, 0.5) FILTER (cluster_id >= 0), 6) AS median_size,
    round(100e0 * sum(n) FILTER (cluster_id >= 0) / sum(n), 6) AS clustered_percent
    FROM (SELECT cluster_id, count(*) AS n FROM labelled GROUP BY 1)''', "points", *_DBSCAN, recursive=True))
def cluster_size_stats(spark, sf):
    return six(C.cluster_sizes(clustered(spark, sf)), "mean_size", "median_size", "clustered_percent")


@query(sql('''SELECT rank, cluster_id FROM labelled WHERE cluster_id IN (SELECT cluster_id FROM labelled
    WHERE cluster_id >= 0 GROUP BY 1 ORDER BY count(*) DESC, cluster_id LIMIT 5)''', "points", *_DBSCAN, recursive=True))
def top_cluster_members(spark, sf):
    return C.in_largest_clusters(clustered(spark, sf), 5).select("rank", "cluster_id")
