"""Masks, NoData rules, normalisation and display transforms."""

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import grid as G
from ..operators.ordering import percentiles_wide
from . import query
from .fixtures import BANDS, bands, grid, shape, six, sql, table, union_all


@query(sql('''SELECT "row", col, p, g FROM grid WHERE valid AND g = 0''', "grid"))
def valid_pixels(spark, sf):
    """Feature mask and label mask both hold."""
    return grid(spark, sf).filter(F.col("valid") & (F.col("g") == 0)).select("row", "col", "p", "g")


@query(sql('''SELECT count(*) FILTER (s = 'F') AS n_finite,
    count(*) FILTER (v IS NULL OR isnan(v) OR isinf(v)) AS finite,
    count(*) FILTER (v IS NULL OR isnan(v) OR isinf(v) OR abs(v) > 1e30) AS huge,
    count(*) FILTER (v IS NULL OR isnan(v) OR isinf(v) OR v = -9999e0) AS nodata,
    count(*) FILTER (v IS NULL OR isnan(v) OR isinf(v) OR v <= -3e38) AS sentinel
    FROM (SELECT o_orderstatus AS s, CASE WHEN o_orderpriority LIKE '1%' THEN NULL
      WHEN o_orderpriority LIKE '2%' THEN 'NaN'::DOUBLE
      WHEN o_orderpriority LIKE '3%' AND o_orderstatus = 'P' THEN 'Infinity'::DOUBLE
      WHEN o_orderpriority LIKE '3%' THEN -9999e0
      WHEN o_orderpriority LIKE '4%' AND o_orderstatus = 'F' THEN -3.40282e38
      WHEN o_orderpriority LIKE '4%' THEN 2e30 ELSE o_totalprice END AS v FROM orders)'''.lstrip(), "w"))
def invalid_value_modes(spark, sf):
    pr, st = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    v = (F.when(pr == "1", F.lit(None).cast("double")).when(pr == "2", F.lit(float("nan")))
         .when((pr == "3") & (st == "P"), F.lit(float("inf"))).when(pr == "3", F.lit(-9999.0))
         .when((pr == "4") & (st == "F"), F.lit(-3.40282e38)).when(pr == "4", F.lit(2e30))
         .otherwise(F.col("o_totalprice")))
    df = table(spark, sf, "orders").select(st.alias("s"), v.alias("v"))
    hit = {"finite": V.is_invalid(F.col("v"), "finite"), "huge": V.is_invalid(F.col("v"), "huge"),
           "nodata": V.is_invalid(F.col("v"), "nodata", -9999.0),
           "sentinel": V.is_invalid(F.col("v"), "sentinel")}
    return df.agg(F.count(F.when(F.col("s") == "F", 1)).alias("n_finite"),
                  *[F.count(F.when(c, 1)).alias(n) for n, c in hit.items()])


@query(sql('''SELECT "row", col, b1, b2, b3, b4, b5 FROM bands WHERE b1 IS NOT NULL AND b2 IS NOT NULL
    AND b3 IS NOT NULL AND b4 IS NOT NULL AND b5 IS NOT NULL''', "bands"))
def finite_pixels(spark, sf):
    return bands(spark, sf).filter(V.all_valid(BANDS)).select("row", "col", *BANDS)


@query(sql('''SELECT band, feature, round(avg(value), 6) AS mean,
    round(CASE WHEN stddev_pop(value) < 1e-8 THEN 1 ELSE stddev_pop(value) END, 6) AS std
    FROM long GROUP BY 1, 2''', "long"))
def band_stats(spark, sf):
    return six(G.band_stats(bands(spark, sf), BANDS), "mean", "std")


_STATS = ("long", "st AS (SELECT " + ", ".join(
    f"avg({b}) AS m{i}, CASE WHEN stddev_pop({b}) < 1e-8 THEN 1e0 ELSE stddev_pop({b}) END AS s{i}"
    for i, b in enumerate(BANDS, 1)) + " FROM bands)")


def _z(i: int, denom: str, fill: str) -> str:
    return (f"least(greatest((coalesce(b{i}, m{i}) - m{i}) / {denom.format(i=i)}, -10e0), 10e0)" if fill == "mean"
            else f"CASE WHEN b{i} IS NULL THEN 0e0 ELSE least(greatest((b{i} - m{i}) / {denom.format(i=i)}, -10e0), 10e0) END")


def _norm_sql(cond: str, denom: str, fill: str) -> str:
    return ", ".join(f"round(CASE WHEN {cond} THEN {_z(i, denom, fill)} ELSE 0e0 END, 6) + 0e0 AS b{i}"
                     for i in range(1, 6))


@query(sql(f'SELECT "row", col, {_norm_sql("valid", "greatest(s{i}, 1e-8)", "mean")} FROM bands, st', *_STATS))
def normalized_bands(spark, sf):
    b = bands(spark, sf)
    out = G.normalize_bands(b, BANDS, G.band_stats(b, BANDS), valid="valid")
    return out.select("row", "col", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in BANDS])


_ALL = " AND ".join(f"b{i} IS NOT NULL" for i in range(1, 6))
_VARIANTS = {
    "add_floor": dict(denom="add"),
    "floor_1e6": dict(floor=1e-6),
    "zero_all": dict(on_invalid="zero_all"),
    "zero_band": dict(on_invalid="zero"),
    "keep": dict(on_invalid="keep"),
}


@query(sql(" UNION ALL ".join([
    f'SELECT \'add_floor\' AS variant, "row", col, {_norm_sql("true", "(s{i} + 1e-8)", "mean")} FROM bands, st',
    f'SELECT \'floor_1e6\', "row", col, {_norm_sql("true", "greatest(s{i}, 1e-6)", "mean")} FROM bands, st',
    f'SELECT \'zero_all\', "row", col, {_norm_sql(_ALL, "greatest(s{i}, 1e-8)", "mean")} FROM bands, st',
    f'SELECT \'zero_band\', "row", col, {_norm_sql("true", "greatest(s{i}, 1e-8)", "zero")} FROM bands, st',
    f'SELECT \'keep\', "row", col, {_norm_sql("true", "greatest(s{i}, 1e-8)", "mean")} FROM bands, st']),
    *_STATS))
def normalization_variants(spark, sf):
    b = bands(spark, sf)
    stats = G.band_stats(b, BANDS)
    return union_all([
        G.normalize_bands(b, BANDS, stats, **kw).select(
            F.lit(name).alias("variant"), "row", "col", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in BANDS])
        for name, kw in _VARIANTS.items()])


@query(sql('SELECT "row", col, g, ' + ", ".join(f"round(coalesce({b}, m_{b}, 0), 6) AS {b}" for b in BANDS)
           + " FROM bands JOIN (SELECT g AS gg, " + ", ".join(f"quantile_cont({b}, 0.5) AS m_{b}" for b in BANDS)
           + " FROM bands GROUP BY 1) ON g = gg", "bands"))
def group_median_imputed(spark, sf):
    out = G.impute_group_median(bands(spark, sf), BANDS, "g")
    return six(out.select("row", "col", "g", *BANDS), *BANDS)


@query(sql('SELECT "row", col, ' + ", ".join(f"round(({b} - m_{b}) / s_{b}, 6) AS {b}" for b in BANDS) + " FROM bands, (SELECT "
           + ", ".join(f"avg({b}) AS m_{b}, stddev_pop({b}) AS s_{b}" for b in BANDS) + " FROM bands WHERE valid)", "bands"))
def standard_scaled(spark, sf):
    """Scaler fitted on the training part (valid pixels), applied to all bands of all pixels."""
    b = bands(spark, sf)
    fit = b.filter("valid").agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in BANDS])).scalar()
    scaled = b.withColumn("_fit", fit)      # one struct per row, read for every band
    return scaled.select("row", "col", *[F.round((F.col(c) - F.col("_fit")[c]["m"]) / F.col("_fit")[c]["s"], 6).alias(c) for c in BANDS])


@query(sql('''SELECT event_id, CASE WHEN v IS NULL OR isnan(v) THEN 0e0 ELSE least(greatest(v, 0e0), 1e0) END AS p
    FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'NaN'::DOUBLE WHEN 'view' THEN 'Infinity'::DOUBLE
      WHEN 'click' THEN '-Infinity'::DOUBLE ELSE value / 100 END AS v FROM events)''', "w"))
def sanitized_predictions(spark, sf):
    t = F.col("event_type")
    v = (F.when(t == "error", F.lit(float("nan"))).when(t == "view", F.lit(float("inf")))
         .when(t == "click", F.lit(float("-inf"))).otherwise(F.col("value") / 100))
    return table(spark, sf, "events").select("event_id", V.sanitize(v).alias("p"))


@query(sql('''SELECT "row", col, round(CASE WHEN pow(p, 0.5e0) >= 0.6e0 THEN pow(p, 0.5e0) ELSE 0e0 END, 6) AS after_t,
    round(CASE WHEN p >= 0.6e0 THEN pow(p, 0.5e0) ELSE 0e0 END, 6) AS before_t FROM grid''', "grid"))
def power_calibration(spark, sf):
    half, cut = F.lit(0.5), F.lit(0.6)
    return grid(spark, sf).select("row", "col",
                                  F.round(V.power_after(F.col("p"), half, cut), 6).alias("after_t"),
                                  F.round(V.power_before(F.col("p"), half, cut), 6).alias("before_t"))


@query(sql('''SELECT "row" * wd + col AS flat, CAST(("row" * wd + col) // wd AS INTEGER) AS r,
    CAST(("row" * wd + col) % wd AS INTEGER) AS c FROM grid, size''', "grid", "size"))
def flat_index(spark, sf):
    size = shape(spark, sf)
    g = grid(spark, sf, size).select(G.flat_index(size.width).alias("flat"))
    return g.select("flat", G.row_of(F.col("flat"), size.width).alias("r"),
                    G.col_of(F.col("flat"), size.width).alias("c"))


@query(sql('SELECT "row", col, p FROM grid2 WHERE p > 0', "grid2"))
def positive_scores(spark, sf):
    from .fixtures import grid2
    return grid2(spark, sf).filter("p > 0").select("row", "col", "p")


@query(sql('''SELECT "row", col FROM grid, size WHERE "row" BETWEEN 15 AND h - 16
    AND col BETWEEN 15 AND wd - 16''', "grid", "size"))
def border_safe_pixels(spark, sf):
    size = shape(spark, sf)
    return grid(spark, sf, size).filter(G.border_safe(size.height, size.width)).select("row", "col")


@query(sql('''SELECT "row", col, b AS block_id FROM (SELECT *, CAST(least("row" // (h // 4), 3) * 4
    + least(col // (wd // 4), 3) AS INTEGER) AS b FROM bands, size) WHERE b IN (1, 7, 9, 10)
    AND "row" BETWEEN 15 AND h - 16 AND col BETWEEN 15 AND wd - 16 AND b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL
    AND b4 IS NOT NULL AND b5 IS NOT NULL''', "bands", "size"))
def safe_validation_pixels(spark, sf):
    size = shape(spark, sf)
    block = G.block_of(size.height, size.width)
    return (bands(spark, sf, size)
            .filter(block.isin(*G.VALIDATION_BLOCKS) & G.border_safe(size.height, size.width)
                    & V.all_valid(BANDS))
            .select("row", "col", block.alias("block_id")))


@query(sql('SELECT "row", col, p >= 0.5e0 AS selected FROM grid', "grid"))
def threshold_mask(spark, sf):
    return grid(spark, sf).select("row", "col", (F.col("p") >= 0.5).alias("selected"))


@query(sql('''SELECT "row", col, CASE WHEN NOT valid THEN NULL WHEN p >= 0.5e0 AND g > 0 THEN 1
    WHEN p >= 0.5e0 THEN 2 WHEN g > 0 THEN 3 ELSE 0 END AS error FROM grid''', "grid"))
def error_classes(spark, sf):
    return grid(spark, sf).select("row", "col", V.error_class(
        F.col("p") >= 0.5, F.col("g") > 0, F.col("valid")).alias("error"))


@query(sql('''SELECT count(*) FILTER (p >= 0.8e0) AS confident, count(*) FILTER (p >= 0.8e0 AND g = 0) AS confident_fp
    FROM grid WHERE valid''', "grid"))
def high_confidence(spark, sf):
    sure = F.col("p") >= 0.8
    return grid(spark, sf).filter("valid").agg(F.count(F.when(sure, 1)).alias("confident"),
                                               F.count(F.when(sure & (F.col("g") == 0), 1)).alias("confident_fp"))


@query(sql('SELECT "row", col, b1, b2, b4, b5 FROM bands', "bands"))
def band_subset(spark, sf):
    from ..plans.models import subset
    return bands(spark, sf).select("row", "col", *subset(BANDS, "V1_no3"))


@query(sql('''SELECT "row", col, CAST(a AS INTEGER) AS ablated, ''' + ", ".join(
    f"CASE WHEN a = {i} THEN 0e0 ELSE b{i} END AS b{i}" for i in range(1, 6))
           + " FROM bands, (SELECT unnest([1, 2, 3, 4, 5]) AS a)", "bands"))
def band_ablation(spark, sf):
    return G.ablations(bands(spark, sf), BANDS).select("row", "col", "ablated", *BANDS)


@query('''WITH c AS (SELECT p_partkey, trim(regexp_replace(translate(translate(lower(trim(p_type || ' (' || p_brand || ')')),
    ' -/.', '____'), '()', ''), '_+', '_', 'g'), '_') AS cleaned FROM part)
    SELECT p_partkey, cleaned, CASE WHEN strpos(cleaned, '_') = 0 THEN cleaned ELSE
      upper(split_part(cleaned, '_', 1)) || ' — ' || array_to_string(list_transform(
        string_split(substr(cleaned, strpos(cleaned, '_') + 1), '_'),
        lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') END AS shown FROM c''')
def band_names(spark, sf):
    """Part types stand in for band descriptions."""
    name = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))
    cleaned = V.clean_band_name(name, F.lit(1))
    return table(spark, sf, "part").select("p_partkey", cleaned.alias("cleaned")).withColumn(
        "shown", V.display_name(F.col("cleaned")))


def _stretch_sql(b: str) -> str:
    return (f"CASE WHEN {b} IS NULL THEN 0 ELSE CAST(floor((least(greatest({b}, lo_{b}), hi_{b}) - lo_{b}) / (hi_{b} - lo_{b}) * 255e0) AS INTEGER) END AS gray_{b}, "
            f"CASE WHEN {b} IS NULL THEN 0 ELSE 220 END AS alpha_{b}")


@query(sql('SELECT "row", col, ' + ", ".join(map(_stretch_sql, BANDS)) + " FROM bands, (SELECT "
           + ", ".join(f"lo_{b}, CASE WHEN hi_{b} <= lo_{b} THEN lo_{b} + 1e-6 ELSE hi_{b} END AS hi_{b}" for b in BANDS) + " FROM (SELECT "
           + ", ".join(f"quantile_cont({b}, 0.02) AS lo_{b}, quantile_cont({b}, 0.98) AS hi_{b}" for b in BANDS) + " FROM bands))", "bands"))
def percentile_stretch(spark, sf):
    """Every band, cut at its own percentiles; one selection finds them all."""
    b = bands(spark, sf)
    cuts = percentiles_wide(G.stack_bands(b, BANDS), "value", {"lo": 0.02, "hi": 0.98}, ["feature"])
    cut = cuts.agg(F.struct(*[F.max(F.when(F.col("feature") == c, F.struct("lo", "hi"))).alias(c) for c in BANDS])).scalar()
    shown = b.withColumn("_cut", cut)
    return shown.select("row", "col", *[x for c in BANDS for x in (
        V.stretch_byte(F.col(c), F.col("_cut")[c]["lo"], F.col("_cut")[c]["hi"]).alias(f"gray_{c}"),
        F.when(V.non_finite(F.col(c)), 0).otherwise(220).alias(f"alpha_{c}"))])


@query(sql('''SELECT "row", col, round(CASE WHEN valid THEN log10(greatest(p, 1e-6)) END, 6) AS log_p FROM grid''', "grid"))
def log_display(spark, sf):
    return grid(spark, sf).select("row", "col", F.round(V.log_display(F.col("p"), F.col("valid")), 6).alias("log_p"))


@query(sql('''SELECT CASE WHEN g > 0 AND p >= 0.8e0 THEN 'tp' WHEN p >= 0.8e0 THEN 'fp' WHEN g > 0 THEN 'fault'
    ELSE 'background' END AS cohort, count(*) AS n, round(avg(p), 6) AS mean_p FROM grid GROUP BY 1''', "grid"))
def pixel_cohorts(spark, sf):
    return grid(spark, sf).groupBy(cohort().alias("cohort")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


def cohort():
    sel, hit = F.col("p") >= 0.8, F.col("g") > 0
    return (F.when(hit & sel, "tp").when(sel, "fp").when(hit, "fault").otherwise("background"))
