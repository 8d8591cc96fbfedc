"""Null values, misaligned rasters, odd shapes and the limits of top-K."""

import pytest
from pyspark.sql import functions as F

from rasterloom.functions.geo import SURVEY_GEO
from rasterloom.operators import evaluation as E
from rasterloom.operators import features as FE
from rasterloom.operators import tiles as T
from rasterloom.operators.grid import impute_group_median
from rasterloom.operators.ordering import best_first, top_k
from rasterloom.operators.thinning import thin
from rasterloom.plans.candidates import candidate_table


def raster(spark, n, width=100):
    return spark.range(n).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"),
                                 (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("p"))


def test_last_row_of_an_odd_raster_is_scored(spark):
    mean = lambda pdf: pdf[["row", "col", "p"]]
    scored = T.score_tiles(raster(spark, 1050), mean, 11, 100, columns=["p"], core=32, step=28, halo=3)
    assert scored.count() == 1050


@pytest.mark.parametrize("use", [
    lambda px: T.halo_tiling(px, 10, 100, core=32, step=28, halo=3),
    lambda px: T.edge_padded(px, px.filter("row < 5"), 1, 10, 100)])
def test_pixels_outside_the_shape_fail(spark, use):
    with pytest.raises(Exception, match="outside the raster"):
        use(raster(spark, 1050)).count()


@pytest.mark.parametrize("use", [E.raster_difference, lambda pairs: E.iou_sweep(pairs, [0.1, 0.5])])
def test_consumers_of_misaligned_rasters_fail(spark, pixels, use):
    a, b = pixels([(0, 0, 0.1), (0, 1, 0.2), (0, 2, 0.3)]), pixels([(0, 0, 0.1), (0, 1, 0.2)])
    with pytest.raises(Exception, match="differ in shape"):
        use(E.aligned(a, b)).collect()
    with pytest.raises(Exception, match="differ in shape"):
        use(E.aligned(b, a)).collect()


def test_null_group_has_its_median(spark):
    df = spark.createDataFrame([(0, i, g, v) for i, (g, v) in enumerate(
        [(None, 1.0), (None, 3.0), (None, None), (1, 8.0), (1, None), (2, None)])], "row int, col int, g int, b1 double")
    got = [r.b1 for r in impute_group_median(df, ["b1"], "g").orderBy("col").collect()]
    assert got == [1.0, 3.0, 2.0, 8.0, 8.0, 0.0]


@pytest.mark.parametrize("k", [None, 3])
def test_pixels_without_score_are_not_picked(spark, k):
    px = spark.createDataFrame([(0, 0, 0.5), (0, 1, None), (0, 9, 0.7), (9, 9, None), (5, 5, 0.1)], "row int, col int, p double")
    assert sorted((r.row, r.col) for r in thin(px, 1, k).collect()) == [(0, 0), (0, 9), (5, 5)]


@pytest.mark.parametrize("k", [5_000, 5_001])
def test_top_k_on_both_sides_of_take_ordered(spark, k):
    px = raster(spark, 12_000)
    want = sorted(((r.p, r.row, r.col) for r in px.collect()), reverse=True)[:k]
    got = top_k(px, k, best_first(), rank="n", lead="p").collect()
    assert [(r.p, r.row, r.col) for r in sorted(got, key=lambda r: r.n)] == want
    assert {(r.p, r.row, r.col) for r in top_k(px, k, best_first(), lead="p").collect()} == set(want)


def test_spearman_takes_all_rows(spark):
    df = spark.range(2_000).select(F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.col("id").cast("double").alias("x"),
                                   (-F.col("id")).cast("double").alias("y"))
    assert FE.spearman_pairs(df, ["x", "y"]).first()["r"] == pytest.approx(-1.0)


def test_a_model_runs_once_per_tile(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer(pdf):
        calls.add(1)
        return pdf[["row", "col", "p"]]

    scored = T.score_tiles(raster(spark, 64 * 64, 64), scorer, 64, 64, columns=["p"], core=32, step=32, halo=3)
    made = candidate_table(scored, k=10, power=5e-5, radius=1, geo=SURVEY_GEO)
    assert made.count() == 10 and calls.value == 4
