"""Parameter sweeps; grids are full, and only K is scaled to the size of the test rasters."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..plans import sweep as Q
from . import query
from .fixtures import grid, shape, six, sql, truth
from .metrics import OFFSETS
from .thinning import ORDER, thin_cte


def steps(lo: float, hi: float, step: float) -> list[float]:
    return [round(lo + i * step, 10) for i in range(int(round((hi - lo) / step)) + 1)]


def _vals(name: str, values) -> str:
    return f"{name}(v) AS (VALUES " + ", ".join(f"({v!r}::DOUBLE)" for v in values) + ")"


def _run(spark, sf, fn, *args, **kw):
    size = shape(spark, sf)
    return fn(grid(spark, sf, size).select("row", "col", "p"), truth(spark, sf, size), *args, **kw)


# The oracle scores each (power, cut) from the joined neighbour lists.
_NEAR = '''near AS MATERIALIZED (SELECT t."row" * 100000::BIGINT + t.col AS t, q."row", q.col, q.p, k FROM truth t CROSS JOIN o
    JOIN grid q ON q."row" = t."row" + dy AND q.col = t.col + dx WHERE q.p > 0)'''
_INFL = '''infl AS MATERIALIZED (SELECT q."row", q.col, q.p, q.g, coalesce(max(k), 0e0) AS infl FROM grid q LEFT JOIN
    (SELECT "row" + dy AS "row", col + dx AS col, k FROM truth CROSS JOIN o) i ON i."row" = q."row" AND i.col = q.col WHERE q.p > 0 GROUP BY 1, 2, 3, 4)'''
_N = "(SELECT count(*) FROM truth)"
_DTI = f"round(tp / (tp + 0.2e0 * fp + 0.8e0 * ({_N} - tp) + 1e-12), 6) AS dti"


def _cut_sql(powers, cuts, cond: str) -> str:
    """``cond`` says when a pixel (p) passes cut c.v under power e.v."""
    return sql(f'''SELECT e.v AS power, c.v AS threshold, round(coalesce(a.tp, 0e0), 6) AS tp, round(coalesce(b.fp, 0e0), 6) AS fp,
        {_N} AS n_truth, coalesce(b.selected, 0) AS selected,
        round(coalesce(a.tp, 0e0) / (coalesce(a.tp, 0e0) + 0.2e0 * coalesce(b.fp, 0e0) + 0.8e0 * ({_N} - coalesce(a.tp, 0e0)) + 1e-12), 6) AS dti
        FROM e CROSS JOIN c
        LEFT JOIN (SELECT ev, cv, sum(best) AS tp FROM (SELECT e.v AS ev, c.v AS cv, t, max(pow(p, e.v) * k) AS best
          FROM near, e, c WHERE {cond} GROUP BY 1, 2, 3) GROUP BY 1, 2) a ON a.ev = e.v AND a.cv = c.v
        LEFT JOIN (SELECT e.v AS ev, c.v AS cv, sum(pow(p, e.v) * (1 - infl)) AS fp, count(*) AS selected
          FROM infl, e, c WHERE {cond} GROUP BY 1, 2) b ON b.ev = e.v AND b.cv = c.v''',
               "truth", OFFSETS, _NEAR, _INFL, _vals("e", powers), _vals("c", cuts))


def _cut_out(df):
    return six(df.select("power", "threshold", "tp", "fp", "n_truth", "selected", "dti"), "tp", "fp", "dti")


POWERS = [1.0, 1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 3.5, 4.0]


def _power_sql(powers) -> str:
    return sql(f'''SELECT v AS power, round(tp, 6) AS tp, round(fp, 6) AS fp, {_DTI} FROM (SELECT e.v,
    (SELECT sum(best) FROM (SELECT t, max(pow(p, e.v) * k) AS best FROM near GROUP BY 1)) AS tp,
    (SELECT sum(pow(p, e.v) * (1 - infl)) FROM infl) AS fp FROM e)''', "truth", OFFSETS, _NEAR, _INFL, _vals("e", powers))


@query(_power_sql(POWERS))
def sweep_power(spark, sf):
    out = _run(spark, sf, Q.power_sweep, POWERS)
    return six(out.select("power", "tp", "fp", "dti"), "tp", "fp", "dti")


PRE_P, PRE_T = steps(1.5, 2.5, 0.05), [
    0.0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.06, 0.075, 0.1, 0.125, 0.15]


@query(_cut_sql(PRE_P, PRE_T, "p >= c.v"))
def sweep_power_threshold_before(spark, sf):
    return _cut_out(_run(spark, sf, Q.threshold_power_sweep, PRE_P, PRE_T, when="before"))


LOCAL_P, LOCAL_T = steps(1.2, 1.7, 0.025), steps(0.1, 0.3, 0.01)


@query(_cut_sql(LOCAL_P, LOCAL_T, "p >= c.v"))
def sweep_power_threshold_local(spark, sf):
    return _cut_out(_run(spark, sf, Q.threshold_power_sweep, LOCAL_P, LOCAL_T, when="before"))


POST_P = [0.5, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.75, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0]
POST_T = steps(0.0, 0.9, 0.05)


@query(_cut_sql(POST_P, POST_T, "pow(p, e.v) >= c.v"))
def sweep_power_threshold_after(spark, sf):
    return _cut_out(_run(spark, sf, Q.threshold_power_sweep, POST_P, POST_T))


FINE_P, FINE_T = steps(0.55, 1.5, 0.05), steps(0.85, 0.99, 0.01)


@query(_cut_sql(FINE_P, FINE_T, "pow(p, e.v) >= c.v"))
def sweep_power_threshold_fine(spark, sf):
    return _cut_out(_run(spark, sf, Q.threshold_power_sweep, FINE_P, FINE_T))


CANON_P, CANON_T = steps(0.5, 3.0, 0.05), steps(0.0, 0.94, 0.02)


@query(_cut_sql(CANON_P, CANON_T, "pow(p, e.v) >= c.v"))
def sweep_power_threshold_canonical(spark, sf):
    """51 powers x 48 thresholds in one job."""
    return _cut_out(_run(spark, sf, Q.threshold_power_sweep, CANON_P, CANON_T))


LIST_P = [0.75, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.75, 2.0, 2.5, 3.0]


@query(_power_sql(LIST_P))
def sweep_power_list(spark, sf):
    return six(_run(spark, sf, Q.power_sweep, LIST_P).select("power", "tp", "fp", "dti"), "tp", "fp", "dti")


QUICK_P, QUICK_T = [1.0, 1.2, 1.5, 2.0], steps(0.05, 0.4, 0.05)


@query(_cut_sql(QUICK_P, QUICK_T, "pow(p, e.v) >= c.v"))
def sweep_power_threshold_quick(spark, sf):
    return _cut_out(_run(spark, sf, Q.threshold_power_sweep, QUICK_P, QUICK_T))


def _rank_sql(ks, powers, picks: list[str], radius_col: str = "") -> str:
    """Cuts on the rank of ``ranked(row, col, p, pick)``."""
    return f'''SELECT e.v AS power, CAST(c.v AS INTEGER) AS k{radius_col}, b.selected, b.hits AS tp_pixels, round(a.tp, 6) AS tp_w, round(b.fp, 6) AS fp_w,
        round(b.hits / b.selected::DOUBLE, 6) AS precision, round(b.hits / {_N}::DOUBLE, 6) AS recall, b.low AS threshold_raw,
        round(a.tp / (a.tp + 0.2e0 * b.fp + 0.8e0 * ({_N} - a.tp) + 1e-12), 6) AS dti
        FROM (SELECT ev, cv, sum(best) AS tp FROM (SELECT e.v AS ev, c.v AS cv, t, max(pow(n.p, e.v) * k) AS best
          FROM near n JOIN ranked r ON r."row" = n."row" AND r.col = n.col, e, c WHERE r.pick <= c.v GROUP BY 1, 2, 3) GROUP BY 1, 2) a
        JOIN (SELECT e.v AS ev, c.v AS cv, sum(pow(i.p, e.v) * (1 - infl)) AS fp, count(*) AS selected,
            count(*) FILTER (i.g > 0) AS hits, min(i.p) AS low
          FROM infl i JOIN ranked r ON r."row" = i."row" AND r.col = i.col, e, c WHERE r.pick <= c.v GROUP BY 1, 2) b
          ON a.ev = b.ev AND a.cv = b.cv JOIN e ON e.v = a.ev JOIN c ON c.v = a.cv'''


def _topk_sql(ks, powers) -> str:
    return sql(_rank_sql(ks, powers, []), "truth", OFFSETS, _NEAR, _INFL, _vals("e", powers), _vals("c", [float(k) for k in ks]),
               f'ranked AS (SELECT "row", col, p, row_number() OVER {ORDER} AS pick FROM grid)')


def _thin_sql(ks, powers, radius: int) -> str:
    return sql(_rank_sql(ks, powers, [], f", {radius} AS thin_radius"), "truth", OFFSETS, _NEAR, _INFL, _vals("e", powers),
               _vals("c", [float(k) for k in ks]), *thin_cte("grid", radius),
               'ranked AS (SELECT "row", col, p, thin_rank AS pick FROM picks)', recursive=True)


def _radii_sql(ks, powers, radii) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({_thin_sql(ks, powers, r)})" for r in radii)


_COLS = ["power", "k", "selected", "tp_pixels", "tp_w", "fp_w", "precision", "recall", "threshold_raw", "dti"]


def _rank_out(df, *extra):
    return six(df.select(*_COLS, *extra), "tp_w", "fp_w", "precision", "recall", "dti")


K20 = [50, 75, 100, 150, 200, 250, 300, 350, 400, 450, 500, 600, 700, 800, 900, 1000, 1200, 1400, 1700, 2000]


@query(_topk_sql(K20, [1.0]))
def sweep_k(spark, sf):
    return _rank_out(_run(spark, sf, Q.top_k_sweep, K20))


K13, P27 = [100, 150, 200, 250, 300, 350, 400, 450, 500, 600, 700, 800, 1000], steps(0.2, 1.5, 0.05)


@query(_topk_sql(K13, P27))
def sweep_k_power(spark, sf):
    return _rank_out(_run(spark, sf, Q.top_k_sweep, K13, P27))


K21, P26 = list(range(350, 560, 10)), steps(0.05, 0.3, 0.01)


@query(_topk_sql(K21, P26))
def sweep_k_power_fine(spark, sf):
    return _rank_out(_run(spark, sf, Q.top_k_sweep, K21, P26))


K49, P10 = list(range(800, 1041, 5)), steps(0.005, 0.05, 0.005)


@query(_topk_sql(K49, P10))
def sweep_k_power_ultra_low(spark, sf):
    return _rank_out(_run(spark, sf, Q.top_k_sweep, K49, P10))


K121 = list(range(430, 551))


@query(_topk_sql(K121, [0.005]))
def sweep_k_fine(spark, sf):
    return _rank_out(_run(spark, sf, Q.top_k_sweep, K121, [0.005]))


K17, P20L = list(range(200, 1001, 50)), steps(0.005, 0.1, 0.005)


@query(_topk_sql(K17, P20L))
def sweep_k_power_other_model(spark, sf):
    return _rank_out(_run(spark, sf, Q.top_k_sweep, K17, P20L))


RADII = [0, 1, 2, 3, 5, 7, 10, 15, 20, 30]


@query(_radii_sql([600], [0.005], RADII))
def sweep_thinning_radius(spark, sf):
    """Ten radii, one thinning each."""
    return _rank_out(_run(spark, sf, Q.thinned_sweep, [600], [0.005], RADII), "thin_radius")


K16 = [100, 150, 200, 250, 300, 350, 400, 450, 500, 550, 600, 650, 700, 800, 900, 1000]


@query(_thin_sql(K16, [0.005], 1))
def sweep_thinned_k(spark, sf):
    return _rank_out(_run(spark, sf, Q.thinned_sweep, K16, [0.005], [1]), "thin_radius")


K33 = list(range(820, 981, 5))


@query(_thin_sql(K33, [0.005], 1))
def sweep_thinned_k_fine(spark, sf):
    return _rank_out(_run(spark, sf, Q.thinned_sweep, K33, [0.005], [1]), "thin_radius")


P20 = steps(0.001, 0.02, 0.001)


@query(_thin_sql([900], P20, 1))
def sweep_thinned_power(spark, sf):
    return _rank_out(_run(spark, sf, Q.thinned_sweep, [900], P20, [1]), "thin_radius")


K10 = [400, 450, 500, 550, 600, 650, 700, 750, 800, 850]


@query(_radii_sql(K10, [0.001], [0, 1, 2, 3]))
def sweep_radius_k(spark, sf):
    return _rank_out(_run(spark, sf, Q.thinned_sweep, K10, [0.001], [0, 1, 2, 3]), "thin_radius")


K8 = [800, 850, 900, 910, 950, 1000, 1050, 1100]
P8B = [5e-4, 0.001, 0.0015, 0.002, 0.003, 0.005, 0.007, 0.01]


@query(_radii_sql(K8, P8B, [1, 2]))
def sweep_k_power_radius(spark, sf):
    return _rank_out(_run(spark, sf, Q.thinned_sweep, K8, P8B, [1, 2]), "thin_radius")


K10B = list(range(820, 911, 10))
P15 = steps(5e-5, 5e-4, 5e-5) + steps(6e-4, 1e-3, 1e-4)


@query(_thin_sql(K10B, P15, 1))
def sweep_k_power_thinned_fine(spark, sf):
    return _rank_out(_run(spark, sf, Q.thinned_sweep, K10B, P15, [1]), "thin_radius")


K17B = list(range(800, 881, 5))


@query(_thin_sql(K17B, [5e-5], 1))
def sweep_k_locked_power(spark, sf):
    return _rank_out(_run(spark, sf, Q.thinned_sweep, K17B, [5e-5], [1]), "thin_radius")


K11, P4 = [800, 820, 830, 835, 840, 845, 850, 855, 860, 880, 900], [5e-5, 1e-4, 5e-4, 1e-3]


@query(_radii_sql(K11, P4, [0, 1]))
def sweep_radius_power_k(spark, sf):
    return _rank_out(_run(spark, sf, Q.thinned_sweep, K11, P4, [0, 1]), "thin_radius")


P9 = [1e-6, 5e-6, 1e-5, 2e-5, 5e-5, 1e-4, 2e-4, 5e-4, 1e-3]


@query(_thin_sql([815], P9, 1))
def sweep_power_only(spark, sf):
    return _rank_out(_run(spark, sf, Q.thinned_sweep, [815], P9, [1]), "thin_radius")


@query(_radii_sql([815], [5e-5], [0, 1, 2, 3]))
def sweep_radius_only(spark, sf):
    return _rank_out(_run(spark, sf, Q.thinned_sweep, [815], [5e-5], [0, 1, 2, 3]), "thin_radius")


@query(_thin_sql([815], [5e-5], 1))
def sweep_fixed_setting(spark, sf):
    return _rank_out(_run(spark, sf, Q.fixed_setting, 815, 5e-5, 1), "thin_radius")


@query(f'''SELECT * FROM ({_topk_sql(K13, [0.2, 0.5, 1.0])}) ORDER BY dti DESC, power, k LIMIT 1''')
def sweep_best(spark, sf):
    """First-wins argmax over rounded scores."""
    return E.best_of(_rank_out(_run(spark, sf, Q.top_k_sweep, K13, [0.2, 0.5, 1.0])), "dti", "power", "k")


@query(f'''SELECT power, k, dti FROM (SELECT *, row_number() OVER (PARTITION BY power ORDER BY dti DESC, k) AS n
    FROM ({_topk_sql(K13, [0.2, 0.5, 1.0])})) WHERE n = 1''')
def sweep_best_per_power(spark, sf):
    out = _rank_out(_run(spark, sf, Q.top_k_sweep, K13, [0.2, 0.5, 1.0]))
    return E.best_per(out, ["power"], "dti", "k").select("power", "k", "dti")


@query(f'''SELECT 'power_0.2' AS model, max(dti) AS best_dti FROM ({_topk_sql(K13, [0.2])}) UNION ALL
    SELECT 'power_1', max(dti) FROM ({_topk_sql(K13, [1.0])})''')
def model_comparison(spark, sf):
    named = {"power_0.2": _rank_out(_run(spark, sf, Q.top_k_sweep, K13, [0.2])),
             "power_1": _rank_out(_run(spark, sf, Q.top_k_sweep, K13, [1.0]))}
    return Q.stack_results(named).groupBy("model").agg(F.max("dti").alias("best_dti"))
