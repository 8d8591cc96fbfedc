"""Distance-weighted Tversky family and scored-table losses."""

from pyspark.sql import functions as F

from ..functions.kernels import box, disc, linear_kernel, weighted_disc
from ..functions.values import sanitize, sigmoid
from ..operators import metric as M
from ..operators.grid import block_of
from . import ORACLES, query
from .fixtures import grid, grid2, shape, six, sql, table, truth, union_all, values_offsets

OFFSETS = values_offsets(weighted_disc(3, linear_kernel(3)))


def dti_cte(pred: str = "grid", truth_name: str = "truth", name: str = "sums", offsets: str = "o") -> str:
    """CTEs with tp, fp, fn, n_truth of a prediction table against a truth table."""
    return f'''{name}_best AS (SELECT t."row", t.col, max(coalesce(q.p, 0e0) * k) AS best
        FROM {truth_name} t CROSS JOIN {offsets} LEFT JOIN {pred} q
        ON q."row" = t."row" + dy AND q.col = t.col + dx GROUP BY 1, 2),
      {name}_infl AS (SELECT "row" + dy AS "row", col + dx AS col, max(k) AS infl
        FROM {truth_name} CROSS JOIN {offsets} GROUP BY 1, 2),
      {name} AS (SELECT coalesce((SELECT sum(best) FROM {name}_best), 0e0) AS tp,
        coalesce((SELECT sum(q.p * (1 - coalesce(i.infl, 0e0))) FROM {pred} q LEFT JOIN {name}_infl i
          ON i."row" = q."row" AND i.col = q.col), 0e0) AS fp,
        (SELECT count(*) FROM {truth_name}) AS n_truth,
        (SELECT count(*) FROM {truth_name}) - coalesce((SELECT sum(best) FROM {name}_best), 0e0) AS fn)'''


DTI = "tp / (tp + 0.2e0 * fp + 0.8e0 * fn + 1e-12)"
ROUNDED = "round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, n_truth"


@query(sql(f"SELECT {ROUNDED}, round({DTI}, 6) AS dti FROM sums", "grid", "truth", OFFSETS, dti_cte()))
def dti_canonical(spark, sf):
    size = shape(spark, sf)
    return six(M.dti(grid(spark, sf, size), truth(spark, sf, size)), "tp", "fp", "fn", "dti")


@query(sql(f"SELECT {ROUNDED}, round({DTI}, 6) AS dti FROM sums", "grid", "truth",
           values_offsets(weighted_disc(15, linear_kernel(15))), dti_cte()))
def dti_wider_radius(spark, sf):
    size = shape(spark, sf)
    return six(M.dti(grid(spark, sf, size), truth(spark, sf, size), radius=15), "tp", "fp", "fn", "dti")


@query(sql('''SELECT 'zero' AS rule, 0e0 AS dti UNION ALL SELECT 'loop', CASE WHEN sum(p) > 0 THEN 0e0 ELSE 1e0 END FROM grid
    UNION ALL SELECT 'denominator', CASE WHEN sum(p) * 0.2 <= 1e-12 THEN 1e0 ELSE 0e0 END FROM grid
    UNION ALL SELECT 'safe', 0e0''', "grid"))
def dti_empty_truth_rules(spark, sf):
    g = grid(spark, sf)
    none = g.filter("g > 1").select("row", "col")
    return union_all([M.dti(g, none, empty_truth=r, eps=0.0 if r == "denominator" else 1e-12)
                      .select(F.lit(r).alias("rule"), F.round("dti", 6).alias("dti"))
                      for r in ("zero", "loop", "denominator", "safe")])


@query(sql(f'''SELECT {ROUNDED}, round(CASE WHEN tp + 0.2e0 * fp + 0.8e0 * fn <= 1e-12 THEN 1e0
    ELSE tp / (tp + 0.2e0 * fp + 0.8e0 * fn) END, 6) AS dti FROM sums''', "grid2",
           '''clean AS (SELECT "row", col, g, CASE WHEN g > 0 AND p > 0.5e0 THEN 0e0 ELSE p END AS p FROM grid2)''',
           'truth2 AS (SELECT "row", col FROM grid2 WHERE g > 0)', OFFSETS, dti_cte("clean", "truth2")))
def dti_sanitized(spark, sf):
    """Predictions with NaN are cleaned first; no epsilon."""
    g = grid2(spark, sf)
    dirty = F.when((F.col("g") > 0) & (F.col("p") > 0.5), F.lit(float("nan"))).otherwise(F.col("p"))
    pred = g.select("row", "col", sanitize(dirty).alias("p"))
    return six(M.dti(pred, g.filter("g > 0").select("row", "col"), eps=0.0, empty_truth="denominator"),
               "tp", "fp", "fn", "dti")


@query(sql(f'''SELECT {ROUNDED}, round(CASE WHEN tp + 0.2e0 * fp + 0.8e0 * fn > 0
    THEN tp / (tp + 0.2e0 * fp + 0.8e0 * fn) ELSE 0e0 END, 6) AS dti FROM sums''', "grid",
           "inside AS (SELECT * FROM grid WHERE valid)",
           'truth3 AS (SELECT "row", col FROM inside WHERE g > 0)', OFFSETS, dti_cte("inside", "truth3")))
def dti_masked(spark, sf):
    g = grid(spark, sf).filter("valid")
    return six(M.dti(g, g.filter("g > 0").select("row", "col"), eps=0.0, empty_truth="safe"),
               "tp", "fp", "fn", "dti")


_BLOCK = 'CAST(least("row" // (h // 4), 3) * 4 + least(col // (wd // 4), 3) AS INTEGER)'


@query(sql(f'''SELECT block_id, {ROUNDED}, round({DTI}, 6) AS dti FROM (SELECT n.block_id, coalesce(tp, 0e0) AS tp,
      coalesce(fp, 0e0) AS fp, n.n AS n_truth, n.n - coalesce(tp, 0e0) AS fn
    FROM (SELECT block_id, count(*) AS n FROM cells WHERE g > 0 GROUP BY 1) n
    LEFT JOIN (SELECT block_id, sum(best) AS tp FROM (SELECT t.block_id, t."row", t.col, max(coalesce(q.p, 0e0) * k) AS best
      FROM cells t CROSS JOIN o LEFT JOIN cells q ON q."row" = t."row" + dy AND q.col = t.col + dx
        AND q.block_id = t.block_id WHERE t.g > 0 GROUP BY 1, 2, 3) GROUP BY 1) a USING (block_id)
    LEFT JOIN (SELECT q.block_id, sum(q.p * (1 - coalesce(infl, 0e0))) AS fp FROM cells q LEFT JOIN
      (SELECT block_id, "row" + dy AS "row", col + dx AS col, max(k) AS infl FROM cells CROSS JOIN o WHERE g > 0 GROUP BY 1, 2, 3) i
      ON i.block_id = q.block_id AND i."row" = q."row" AND i.col = q.col GROUP BY 1) b USING (block_id))''',
           "grid", "size", OFFSETS, f'cells AS (SELECT *, {_BLOCK} AS block_id FROM grid, size)'))
def dti_per_block(spark, sf):
    """Every block scored against its own truth in one job."""
    size = shape(spark, sf)
    g = grid(spark, sf, size).withColumn("block_id", block_of(size.height, size.width))
    out = M.dti(g, g.filter("g > 0").select("block_id", "row", "col"), by=["block_id"], truth_by=["block_id"])
    return six(out, "tp", "fp", "fn", "dti")


_NEAR = values_offsets([(dy, dx, 1 / (1 + d)) for dy, dx, d in disc(3)])


@query(sql('''SELECT round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn,
    round(tp / (tp + 0.2e0 * fp + 0.8e0 * fn + 1e-8), 6) AS score FROM (
    SELECT sum(CASE WHEN g > 0 THEN p END) AS tp, sum(CASE WHEN g > 0 THEN 1 - p END) AS fn,
      sum(CASE WHEN g = 0 THEN p * (1 - coalesce(w, 0e0)) END) AS fp
    FROM grid a LEFT JOIN (SELECT "row" + dy AS "row", col + dx AS col, max(k) AS w FROM truth CROSS JOIN o GROUP BY 1, 2) i
      ON i."row" = a."row" AND i.col = a.col)''', "grid", "truth", _NEAR))
def dti_truth_only(spark, sf):
    size = shape(spark, sf)
    return six(M.dti_truth_only(grid(spark, sf, size), truth(spark, sf, size)), "tp", "fp", "fn", "score")


_BOX = values_offsets([(dy, dx, 1.0) for dy, dx, _ in box(3)])
_DIST = values_offsets([(dy, dx, d) for dy, dx, d in disc(3)], "od")


@query(sql('''SELECT round(tp, 6) AS tp, round(fp, 6) AS fp, round(n_truth - tp, 6) AS fn, n_truth,
    round(tp / (tp + 0.2e0 * fp + 0.8e0 * (n_truth - tp) + 1e-7), 6) AS score FROM (SELECT
      (SELECT sum(best) FROM (SELECT t."row", t.col, max(q.p) AS best FROM truth t CROSS JOIN o
        JOIN grid q ON q."row" = t."row" + dy AND q.col = t.col + dx GROUP BY 1, 2)) AS tp,
      (SELECT count(*) FROM truth) AS n_truth,
      (SELECT sum(p * least(coalesce(d, 3e0) / 3e0, 1e0)) FROM grid a LEFT JOIN
        (SELECT "row" + dy AS "row", col + dx AS col, min(k) AS d FROM truth CROSS JOIN od GROUP BY 1, 2) i
        ON i."row" = a."row" AND i.col = a.col WHERE g = 0) AS fp)''', "grid", "truth", _BOX, _DIST))
def dti_box_match(spark, sf):
    size = shape(spark, sf)
    out = M.dti_box(grid(spark, sf, size), truth(spark, sf, size))
    return six(out.select("tp", "fp", "fn", "n_truth", "score"), "tp", "fp", "fn", "score")


def patch_cells(spark, sf):
    """Embeddings as 8x8 patches: p is a squashed value, g and valid are thresholds on it."""
    cells = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    x = F.col("v").cast("double")
    return cells.select("vec_id", "label", F.floor(F.col("i") / 8).cast("int").alias("row"),
                        (F.col("i") % 8).cast("int").alias("col"), sigmoid(x * 5).alias("p"),
                        (x > 0.15).cast("int").alias("g"), (x > -0.2).alias("valid"))


PATCHES = '''cells AS (SELECT vec_id, label, CAST((i - 1) // 8 AS INTEGER) AS "row", CAST((i - 1) % 8 AS INTEGER) AS col,
    1e0 / (1e0 + exp(-(v * 5e0))) AS p, CAST(v > 0.15e0 AS INTEGER) AS g, v > -0.2e0 AS valid FROM (
      SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))'''


@query(sql('''SELECT n.vec_id, round(coalesce(tp, 0e0), 6) AS tp, round(coalesce(fp, 0e0), 6) AS fp,
    round(n_truth - coalesce(tp, 0e0), 6) AS fn, n_truth,
    round(coalesce(tp, 0e0) / (coalesce(tp, 0e0) + 0.2e0 * coalesce(fp, 0e0) + 0.8e0 * (n_truth - coalesce(tp, 0e0)) + 1e-7), 6) AS score
    FROM (SELECT vec_id, count(*) AS n_truth FROM inner_c WHERE g > 0 GROUP BY 1) n
    LEFT JOIN (SELECT vec_id, sum(best) AS tp FROM (SELECT t.vec_id, t."row", t.col, max(q.p * k) AS best
      FROM inner_c t CROSS JOIN o JOIN cells q ON q.vec_id = t.vec_id AND q."row" = t."row" + dy AND q.col = t.col + dx
      WHERE t.g > 0 AND t.valid GROUP BY 1, 2, 3) GROUP BY 1) a USING (vec_id)
    LEFT JOIN (SELECT q.vec_id, sum(q.p * (1 - coalesce(w, 0e0))) AS fp FROM inner_c q LEFT JOIN
      (SELECT vec_id, "row" + dy AS "row", col + dx AS col, max(k) AS w FROM cells CROSS JOIN o WHERE g > 0 GROUP BY 1, 2, 3) i
      ON i.vec_id = q.vec_id AND i."row" = q."row" AND i.col = q.col WHERE q.valid GROUP BY 1) b USING (vec_id)''',
           PATCHES, 'inner_c AS (SELECT * FROM cells WHERE "row" BETWEEN 3 AND 4 AND col BETWEEN 3 AND 4)', OFFSETS))
def patch_scores(spark, sf):
    out = M.patch_dti(patch_cells(spark, sf), ["vec_id"], 8)
    return six(out.select("vec_id", "tp", "fp", "fn", "n_truth", "score"), "tp", "fp", "fn", "score")


@query(f"SELECT count(*) AS patches, round(avg(score), 6) AS mean_score FROM ({ORACLES['patch_scores']})")
def patch_mean_score(spark, sf):
    """Mean over the patches that hold truth."""
    out = M.patch_dti(patch_cells(spark, sf), ["vec_id"], 8)
    return out.agg(F.count(F.lit(1)).alias("patches"), F.round(F.avg(F.round("score", 6)), 6).alias("mean_score"))


_SOFT = "sum({w} * p * g) AS tp, sum({w} * p * (1 - g)) AS fp, sum({w} * (1 - p) * g) AS fn"


@query(sql(f'''SELECT label, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn,
    round((tp + 1e-6) / (tp + 0.2e0 * fp + 0.8e0 * fn + 1e-6), 6) AS score
    FROM (SELECT label, {_SOFT.format(w="1e0")} FROM cells GROUP BY 1)''', PATCHES))
def soft_tversky_by_label(spark, sf):
    return six(M.soft_tversky(patch_cells(spark, sf), ["label"]), "tp", "fp", "fn", "score")


@query(sql(f'''SELECT round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn,
    round(tp / (tp + 0.3e0 * fp + 0.7e0 * fn + 1e-7), 6) AS score
    FROM (SELECT {_SOFT.format(w="1e0")} FROM grid)''', "grid"))
def soft_tversky_global(spark, sf):
    return six(M.soft_tversky(grid(spark, sf), alpha=0.3, beta=0.7, smooth=0.0, eps=1e-7), "tp", "fp", "fn", "score")


_CW = 'greatest(1 - sqrt((("row" - 4) * ("row" - 4) + (col - 4) * (col - 4))::DOUBLE) / 3e0, 0e0)'


@query(sql(f'''SELECT round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn,
    round(tp / (tp + 0.2e0 * fp + 0.8e0 * fn + 1e-6), 6) AS score
    FROM (SELECT {_SOFT.format(w=_CW)} FROM cells)''', PATCHES))
def centre_weighted_tversky(spark, sf):
    dy, dx = F.col("row") - 4, F.col("col") - 4
    w = F.greatest(1 - F.sqrt((dy * dy + dx * dx).cast("double")) / 3, F.lit(0.0))
    return six(M.soft_tversky(patch_cells(spark, sf), weight=w, smooth=0.0, eps=1e-6), "tp", "fp", "fn", "score")


@query(sql(f'''SELECT round(avg(1 - tp / (tp + 0.2e0 * fp + 0.8e0 * fn + 1e-6)), 6) AS loss
    FROM (SELECT vec_id, {_SOFT.format(w="1e0")} FROM cells GROUP BY 1)''', PATCHES))
def distance_target_tversky(spark, sf):
    """Targets are truth pixels, where the distance weight 1 - d/(r+1) is 1."""
    per = M.soft_tversky(patch_cells(spark, sf), ["vec_id"], smooth=0.0, eps=1e-6, hit_weight=F.lit(1.0))
    return per.agg(F.round(F.avg(1 - F.col("score")), 6).alias("loss"))


def _bce(w: float) -> str:
    return f"(-({w}e0 * g * ln(p) + (1 - g) * ln(1 - p)))"


_FOCAL = "pow(1 - CASE WHEN g > 0 THEN p ELSE 1 - p END, 2e0)"
_LOSS_NAMES = ["masked_bce", "bce_4", "bce_2", "bce_1_5", "bce_1", "focal_weighted", "focal", "fp_penalty",
               "tversky_loss", "tversky_loss_37", "mix_half", "mix_bce_focal", "mix_tversky_focal_bce",
               "mix_tversky_focal_fp", "mix_bce_tversky", "mix_bce_tversky_37"]


@query(sql("SELECT label, " + ", ".join(f"round({c}, 6) AS {c}" for c in _LOSS_NAMES) + " FROM (SELECT *, "
           "0.5e0 * masked_bce + 0.5e0 * tversky_loss AS mix_half, 0.45e0 * bce_4 + 0.55e0 * focal_weighted AS mix_bce_focal, "
           "0.55e0 * tversky_loss + 0.3e0 * focal + 0.15e0 * bce_2 AS mix_tversky_focal_bce, "
           "0.55e0 * tversky_loss + 0.3e0 * focal + 0.15e0 * fp_penalty AS mix_tversky_focal_fp, "
           "0.55e0 * bce_1_5 + 0.45e0 * tversky_loss AS mix_bce_tversky, "
           "0.55e0 * bce_1 + 0.45e0 * tversky_loss_37 AS mix_bce_tversky_37 FROM (SELECT *, "
           "1 - (tp + 1e-6) / (tp + 0.2e0 * fp + 0.8e0 * fn + 1e-6) AS tversky_loss, "
           "1 - tp / (tp + 0.3e0 * fp + 0.7e0 * fn + 1e-7) AS tversky_loss_37 FROM (SELECT label, "
           f"sum(CASE WHEN valid THEN {_bce(4)} ELSE 0e0 END) / greatest(sum(valid::INTEGER), 1) AS masked_bce, "
           f"avg({_bce(4)}) AS bce_4, avg({_bce(2)}) AS bce_2, avg({_bce(1.5)}) AS bce_1_5, avg({_bce(1)}) AS bce_1, "
           f"avg({_FOCAL} * {_bce(4)}) AS focal_weighted, avg({_FOCAL} * {_bce(1)}) AS focal, "
           "avg(pow(p * (1 - g), 2e0)) AS fp_penalty, sum(p * g) AS tp, sum(p * (1 - g)) AS fp, sum((1 - p) * g) AS fn "
           "FROM cells GROUP BY 1)))", PATCHES))
def loss_terms(spark, sf):
    out = M.losses(patch_cells(spark, sf), ["label"])
    return six(out, *_LOSS_NAMES)
