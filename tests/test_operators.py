"""Focal, ordering, search, sampling and guard behaviour on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import values as V
from rasterloom.functions.geo import SURVEY_GEO
from rasterloom.functions.kernels import disc, linear_kernel, weighted_disc
from rasterloom.operators import evaluation as E
from rasterloom.operators import features as FE
from rasterloom.operators import grid as G
from rasterloom.operators import ordering as O
from rasterloom.operators import sampling as R
from rasterloom.operators import search as S
from rasterloom.operators import tiles as T
from rasterloom.plans import sweep as Q


def test_disc_sizes():
    assert len(disc(3)) == 29
    assert len(weighted_disc(3, linear_kernel(3))) == 25


@pytest.mark.parametrize("how,box,tile", [("sum", 2, 8), ("max", 3, 7), ("min", 1, 16)])
def test_focal_box(spark, pixels, how, box, tile):
    a = np.random.default_rng(1).random((19, 23))
    got = np.full(a.shape, np.nan)
    for r in T.focal(pixels(a), "p", how=how, box=box, name="v", tile=tile).collect():
        got[r["row"], r["col"]] = r["v"]
    fn = {"sum": np.sum, "max": np.max, "min": np.min}[how]
    want = np.array([[fn(a[max(0, r - box):r + box + 1, max(0, c - box):c + box + 1])
                      for c in range(23)] for r in range(19)])
    assert np.allclose(got, want)


def test_focal_dense_fills_absent_cells(spark, pixels):
    out = T.focal(pixels([(5, 5, 1.0)]), "p", how="dist", offsets=disc(2), name="d", tile=4, dense=(9, 9))
    got = {(r["row"], r["col"]): r["d"] for r in out.collect()}
    assert len(got) == 81
    assert got[(5, 7)] == 2.0 and got[(4, 4)] == pytest.approx(math.sqrt(2)) and got[(0, 0)] is None


def test_global_rank_with_hot_value(spark):
    df = spark.range(3000).select(F.col("id").alias("row"), F.lit(0).alias("col"),
                                  F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 3000.0).alias("p"))
    rows = O.global_rank(df, O.best_first()).collect()
    want = sorted(((r["p"], r["row"]) for r in rows), reverse=True)
    assert [(r["p"], r["row"]) for r in sorted(rows, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in rows) == list(range(1, 3001))


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), np.round(rng.normal(size=500), 1))]
    got = O.percentiles(spark.createDataFrame(data, "g int, v double"), "v", [0, 0.1, 0.5, 0.99, 1], ["g"]).collect()
    for r in got:
        want = np.percentile([v for g, v in data if g == r["g"]], r["q"] * 100)
        assert r["value"] == pytest.approx(want)


def test_nearest_truth_levels(spark, pixels):
    rng = np.random.default_rng(4)
    truth = [(int(r), int(c)) for r, c in rng.integers(0, 12, (15, 2))] + [(300, 280)]
    pts = [(int(r), int(c)) for r, c in rng.integers(0, 320, (60, 2))]
    rows = S.nearest_truth(pixels(pts, "row int, col int"), pixels(truth, "row int, col int"), cells=64).collect()
    assert {(r["row"], r["col"]) for r in rows} == set(pts)
    for r in rows:
        want = min(math.hypot(r["row"] - a, r["col"] - b) for a, b in truth)
        assert r["distance_px"] == pytest.approx(want)
        assert r["distance_m"] == pytest.approx(want * 100)


def test_nearest_truth_empty_sides(spark, pixels):
    one, none = pixels([(1, 1)], "row int, col int"), pixels([], "row int, col int")
    assert S.nearest_truth(one, none).first()["distance_m"] == math.inf
    assert S.nearest_truth(none, one).count() == 0


def test_radius_search_across_date_line(spark):
    cand = spark.createDataFrame([(1, 179.95, 10.0), (2, -179.95, 10.0), (3, 0.0, 10.0), (4, 30.0, 89.5)],
                                 "rank long, longitude double, latitude double")
    srch = spark.createDataFrame([(1, 179.99, 10.0, 20.0), (2, -150.0, 89.5, 150.0)],
                                 "search_id long, lon double, lat double, radius_km double")
    got = {(r["search_id"], r["rank"]) for r in S.radius_search(cand, srch).collect()}
    assert got == {(1, 1), (1, 2), (2, 4)}


def test_corners_match_published_metadata(spark):
    prof = spark.createDataFrame([(3730, 3292)], "r int, c int").select(
        F.lit(SURVEY_GEO.left).alias("left_m"), F.lit(4508550.0).alias("top_m"),
        F.lit(572550.0).alias("right_m"), F.lit(4135550.0).alias("bottom_m"))
    got = {r["corner"]: (r["longitude"], r["latitude"]) for r in G.raster_corners(prof, SURVEY_GEO).collect()}
    want = {"top_left": (-120.03717095080793, 40.68790996512679),
            "top_right": (-116.14092181157623, 40.724684241933026),
            "bottom_right": (-116.1806993259869, 37.363836641005776),
            "bottom_left": (-119.89676789215099, 37.33119286569775)}
    for name, (lon, lat) in want.items():
        assert got[name][0] == pytest.approx(lon, abs=1e-8)
        assert got[name][1] == pytest.approx(lat, abs=1e-8)


def test_distance_to_split_counts_blocks_only(spark, pixels):
    pts = pixels([(0, 0), (10, 10), (39, 39)], "row int, col int")
    got = [r["d"] for r in G.with_split_distance(pts, 40, 40, (1, 7, 9, 10), "d").collect()]
    cells = [(r, c) for b, r0, r1, c0, c1 in G.block_rectangles(40, 40) if b in (1, 7, 9, 10)
             for r in range(r0, r1) for c in range(c0, c1)]
    want = [min(math.hypot(r - a, c - b) for a, b in cells) for r, c in ((0, 0), (10, 10), (39, 39))]
    assert got == pytest.approx(want)


def test_display_and_clean_names(spark):
    df = spark.createDataFrame([(1, "Mag Anom (field) - Earth's x/y"), (2, None), (12, "")], "i int, n string")
    got = [r[0] for r in df.select(V.clean_band_name(F.col("n"), F.col("i"))).collect()]
    assert got == ["mag_anom_field_earth's_x_y", "rtp", "band_12"]
    shown = spark.createDataFrame([("mag_anom_earth's field",), ("plain",)], "n string")
    assert [r[0] for r in shown.select(V.display_name(F.col("n"))).collect()] == ["MAG — Anom Earth'S Field", "plain"]


def test_samples_are_exact_and_repeatable(spark, pixels):
    df = pixels(np.zeros((30, 30)))
    a, b = R.sample_exact(df, 77).collect(), R.sample_exact(df.repartition(7), 77).collect()
    assert len(a) == 77 and sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert R.sample_exact(df, 5000).count() == 900


def test_balance_guard_and_strict_quota(spark, pixels):
    only = pixels([(0, 0, 0.1)]).withColumn("label", F.lit(0))
    with pytest.raises(ValueError):
        R.balance_symmetric(only)
    with pytest.raises(ValueError):
        R.stratified(only.withColumn("s", F.lit("hard")), "s", {"hard": 2}, strict=True)


def test_aligned_rejects_other_shape(spark, pixels):
    with pytest.raises(Exception, match="differ in shape"):
        E.aligned(pixels([(0, 0, 0.1)]), pixels([(0, 1, 0.1)])).collect()


def test_patches_raise_or_skip(spark, pixels):
    df, at = pixels(np.zeros((6, 6))), pixels([(0, 0), (3, 3)], "row int, col int")
    assert T.patches(df, at, 1, ["p"], "skip").count() == 1
    with pytest.raises(Exception, match="incomplete patch"):
        T.patches(df, at, 1, ["p"], "raise").collect()


def test_spearman_sample(spark):
    df = spark.range(400).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"),
                                 F.col("id").cast("double").alias("x"), F.pow(F.col("id"), F.lit(3.0)).alias("y"))
    assert FE.spearman_pairs(df, ["x", "y"], sample=100).first()["r"] == pytest.approx(1.0)


def test_threshold_sweep_equals_single_scores(spark, pixels):
    from rasterloom.operators.metric import dti
    rng = np.random.default_rng(9)
    p = np.round(rng.random((16, 16)), 2)
    truth = pixels([tuple(map(int, t)) for t in np.argwhere(rng.random((16, 16)) < 0.1)], "row int, col int")
    df = pixels(p)
    for when in ("after", "before"):
        for r in Q.threshold_power_sweep(df, truth, [0.5, 2.0], [0.0, 0.3, 0.7, 0.99], when).collect():
            fn = V.power_after if when == "after" else V.power_before
            one = df.withColumn("p", fn(F.col("p"), F.lit(r["power"]), F.lit(r["threshold"])))
            assert r["dti"] == pytest.approx(dti(one, truth).first()["dti"], abs=1e-10)


def test_locked_order_of_equal_scores(spark, pixels):
    rows = O.top_k(pixels([(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.5)]), 2, O.best_first()).collect()
    assert [(r["row"], r["col"]) for r in rows] == [(1, 0), (0, 1)]
