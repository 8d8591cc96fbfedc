"""Selection, ranks, distance transform, search pyramid, breakpoints and stores against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import components as C
from rasterloom.operators import features as FE
from rasterloom.operators import ordering as O
from rasterloom.operators import sampling as R
from rasterloom.operators import search as S
from rasterloom.operators import tiles as T
from rasterloom.operators import transform as X
from rasterloom.functions.geo import EARTH_RADIUS_KM
from rasterloom.plans import sweep as Q
from rasterloom.plans.candidates import create_candidates
from rasterloom.session import shared_path
from rasterloom.sources import tables as ST


@pytest.mark.parametrize("exact", [2_000_000, 20])
def test_percentiles_by_selection(spark, monkeypatch, exact):
    """Wide ranges, powers of two, ties, zeros of both signs, a NULL group; with and without finer passes."""
    monkeypatch.setattr(O, "_EXACT", exact)
    monkeypatch.setattr(O, "_FINE", 8)
    rng = np.random.default_rng(5)
    values = {"wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 150), -(10.0 ** rng.uniform(-5, 5, 50))]),
              "two": 2.0 ** rng.integers(-3, 4, 90), "tie": np.repeat([0.0, -0.0, 7.5], [80, 10, 10]),
              None: rng.normal(size=101), "one": np.array([3.25]), "close": 1 + rng.random(200) * 1e-12}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("one", None), ("one", float("nan"))]
    qs = [0, 0.1, 0.5, 0.77, 1]
    got = {(r["g"], r["q"]): r["value"] for r in O.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", qs, ["g"]).collect()}
    assert len(got) == len(values) * len(qs)
    for g, vs in values.items():
        for q in qs:
            assert got[g, q] == pytest.approx(np.percentile(vs, 100 * q), rel=1e-12, abs=1e-300)
    alone = O.percentiles(spark.createDataFrame([(1.0,), (math.inf,), (-math.inf,)], "v double"), "v", [0, 0.5, 1]).collect()
    assert sorted(r["value"] for r in alone) == [-math.inf, 1.0, math.inf]
    assert O.percentiles(spark.createDataFrame([], "g int, v double"), "v", [0.5], ["g"]).count() == 0


def test_null_groups_and_labels_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {r["g"]: r["m"] for r in FE.summary(df, "v", {"m": 0.5}, ["g"]).collect()} == {None: 2.0, "a": 5.0}
    rows = spark.createDataFrame([(i, 0, i % 3 if i % 3 else None) for i in range(30)], "row int, col int, label int")
    out = R.split_fraction(rows, "label", 0.2).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("split") == "test", 1)).alias("t")).collect()
    assert {r["label"]: (r["n"], r["t"]) for r in out} == {None: (10, 2), 1: (10, 2), 2: (10, 2)}


def test_average_ranks_of_a_hot_value(spark):
    """A value of nine rows in ten fills many partitions; ranks come without a join on it."""
    rng = np.random.default_rng(6)
    rows = [(b, i, float(v)) for b in ("x", "y", None) for i, v in
            enumerate(np.where(rng.random(700) < 0.9, 0.0, rng.integers(-4, 5, 700)))]
    df = spark.createDataFrame(rows, "b string, i int, v double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = O.with_average_ranks(df, "v", ["b"], ["i"])
        got = {(r["b"], r["i"]): r["avg_rank"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for b in ("x", "y", None):
        own = [(i, v) for bb, i, v in rows if bb == b]
        vs = np.array([v for _, v in own])
        for i, v in own:
            assert got[b, i] == (vs < v).sum() + ((vs == v).sum() + 1) / 2


@pytest.mark.parametrize("cells,least", [(1 << 21, 16), (120, 2)])
def test_nearest_truth_of_near_far_and_crowded_pixels(spark, pixels, monkeypatch, cells, least):
    monkeypatch.setattr(X, "_LEAST_ROWS", least)
    rng = np.random.default_rng(7)
    truth = {(int(r), int(c)) for r, c in zip(rng.integers(0, 9, 60), rng.integers(40, 60, 60))} | {(95, 3)}
    points = {(r, c) for r in range(0, 100, 3) for c in range(0, 60, 7)} | {(95, 3), (-4, -2)}
    got = X.nearest_truth(pixels(list(points), "row int, col int"), pixels(list(truth), "row int, col int"), 10.0, cells).collect()
    assert len(got) == len(points)
    for r in got:
        want = min(math.hypot(r["row"] - y, r["col"] - x) for y, x in truth)
        assert r["distance_px"] == pytest.approx(want, abs=1e-12) and r["distance_m"] == pytest.approx(10 * want)


def test_envelope_equals_all_parabolas():
    rng = np.random.default_rng(8)
    squares = rng.integers(0, 400, (50, 37)).astype(np.int64)
    squares[rng.random(squares.shape) < 0.5] = X._FAR ** 2
    squares[:, 0] = 9
    x = np.arange(37)
    assert (X.envelope(squares) == (squares[:, None, :] + (x[:, None] - x[None]) ** 2).min(axis=2)).all()


def haversine(lon1, lat1, lon2, lat2):
    a = (math.sin(math.radians(lat2 - lat1) / 2) ** 2
         + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2)
    return 2 * EARTH_RADIUS_KM * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def test_a_huge_circle_among_small_ones(spark):
    """Date line, pole and sizes from 10 m to 5,000 km in one call."""
    rng = np.random.default_rng(9)
    cand = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-180, 180, 400), rng.uniform(-89.9, 89.9, 400)))]
    cand += [(400 + i, -117.0 + i * 1e-4, 40.0) for i in range(50)]
    small = [(i, -117.0 + 2 * i * 1e-4, 40.0, 0.01 + 0.05 * i) for i in range(10)]
    searches = small + [(50, 10.0, 20.0, 5000.0), (51, 179.9, -10.0, 900.0), (52, 0.0, 89.0, 700.0), (53, 0.0, 0.0, 0.0)]
    c = spark.createDataFrame(cand, "rank int, longitude double, latitude double")
    s = spark.createDataFrame(searches, "search_id int, lon double, lat double, radius_km double")
    got = {(r["search_id"], r["rank"]) for r in S.radius_search(c, s).collect()}
    want = {(i, k) for i, lon, lat, km in searches for k, x, y in cand if haversine(lon, lat, x, y) <= km}
    assert got == want and S.radius_search(c, s.limit(0)).count() == 0


def test_breakpoints_admit_exactly():
    steps = Q.powered_steps([0.5, 1.0, 3.0], [0.9, 0.5, 0.0])
    p = np.unique(np.concatenate([np.array(steps.edges), np.nextafter(steps.edges, 0), np.linspace(0.001, 1, 500)]))
    bins = steps.bins(p)
    for e, k, at in steps.answers:
        power, cut = [0.5, 1.0, 3.0][e], [0.9, 0.5, 0.0][k]
        assert ((bins <= at) == (np.array([x ** power for x in p.tolist()]) >= cut)).all()


def test_components_through_salted_roots(spark, pixels, monkeypatch):
    ring = [(0, c) for c in range(40)] + [(r, 39) for r in range(1, 20)] + [(15, 3), (16, 3)]
    df = pixels(ring, "row int, col int")
    whole = {(r["row"], r["col"]): r["root"] for r in C.connected_components(df, tile=4).collect()}
    monkeypatch.setattr(C, "_FEW_ROOTS", -1)
    assert {(r["row"], r["col"]): r["root"] for r in C.connected_components(df, tile=4).collect()} == whole
    assert len(set(whole.values())) == 2


def test_strips_are_pruned_and_need_no_shuffle(spark, pixels):
    path = shared_path(spark, "strips")
    ST.write_strips(pixels([(r, c, 0.5) for r in range(100) for c in range(3)]), path, 10)
    some = ST.read_strips(spark, path, 25, 40, 10)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 45 and "PartitionFilters: [isnotnull(strip" in plan and "Exchange" not in plan


def test_geojson_files_and_clipped_scores(spark, pixels):
    cand = create_candidates(pixels([(0, 0, 1.2), (0, 9, 0.5), (9, 9, float("nan")), (5, 0, 1.0)]), 10, 0.5, 1)
    assert {(r["rank"], r["raw_model_probability"]) for r in cand.collect()} == {(1, 1.0), (2, 1.0), (3, 0.5)}
    table = cand.select("rank", "row", F.col("col").alias("column"), "ranking_score", *[F.lit(v).alias(n) for n, v in
                        (("x", 1.0), ("y", 2.0), ("longitude", 3.0), ("latitude", 4.0))])
    path = shared_path(spark, "geojson")
    ST.write_geojson(table, path, size=2)
    assert sorted(r["rank"] for r in ST.read_geojson(spark, path, lines=True).collect()) == [1, 2, 3]


def test_box_statistics_of_several_columns(spark):
    a = np.random.default_rng(10).random((9, 11))
    a[2, 3] = np.nan
    rows = [(r, c, None if np.isnan(a[r, c]) else float(a[r, c]), float(r)) for r in range(9) for c in range(11)]
    got = {(r["row"], r["col"]): r for r in T.box_statistics(
        spark.createDataFrame(rows, "row int, col int, u double, w double"), ["u", "w"], 1, tile=4).collect()}
    for (r, c), row in got.items():
        near = a[max(0, r - 1):r + 2, max(0, c - 1):c + 2]
        assert row["u_low"] == np.nanmin(near) and row["u_high"] == np.nanmax(near)
        assert row["u_total"] == pytest.approx(np.nansum(near)) and row["w_high"] == min(r + 1, 8)
    assert len(got) == 99
