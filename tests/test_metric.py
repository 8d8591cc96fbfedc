"""Golden and differential cases of the distance-weighted Tversky score."""

import math

import numpy as np
import pytest

from rasterloom.operators import metric as M

CASES = {
    "perfect": ([(7, 7)], [(7, 7, 1.0)], 1.0),
    "one_pixel_shift": ([(7, 7)], [(7, 8, 1.0)], 0.666667),
    "far_away": ([(5, 5)], [(15, 15, 1.0)], 0.0),
    "soft_nearby": ([(7, 7)], [(7, 7, 0.8), (7, 8, 0.6), (8, 7, 0.4)], 0.779221),
    "soft_line": ([(10, 10)], [(10, 10, 0.7), (10, 11, 0.5), (10, 12, 0.3)], 0.690789),
    "none": ([(7, 7)], [(7, 7, 0.0)], 0.0),
    "multiple": ([(5, 5), (10, 20), (22, 10), (25, 25)],
                 [(5, 6, 0.9), (10, 20, 0.8), (21, 10, 0.7), (27, 27, 0.6)], 0.500258),
}


def brute(truth, pred, radius=3.0):
    def k(a, b):
        return max(1 - math.hypot(a[0] - b[0], a[1] - b[1]) / radius, 0)
    tp = sum(max([p * k(t, (r, c)) for r, c, p in pred], default=0) for t in truth)
    fp = sum(p * (1 - max([k(t, (r, c)) for t in truth], default=0)) for r, c, p in pred)
    fn = len(truth) - tp
    return tp, fp, fn, tp / (tp + 0.2 * fp + 0.8 * fn + 1e-12)


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, pixels, name):
    truth, pred, want = CASES[name]
    got = M.dti(pixels(pred), pixels(truth, "row int, col int")).first()
    assert got["dti"] == pytest.approx(want, abs=1e-6)
    assert got["n_truth"] == len(truth)


def test_random_matches_loop(spark, pixels):
    rng = np.random.default_rng(42)
    truth = [tuple(map(int, rc)) for rc in np.argwhere(rng.random((20, 20)) < 0.03)]
    p = rng.random((20, 20))
    pred = [(r, c, float(p[r, c])) for r in range(20) for c in range(20)]
    got = M.dti(pixels(pred), pixels(truth, "row int, col int")).first()
    for name, want in zip(("tp", "fp", "fn", "dti"), brute(truth, pred)):
        assert got[name] == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("rule,with_pred,without_pred", [
    ("zero", 0.0, 0.0), ("loop", 0.0, 1.0), ("denominator", 0.0, 1.0), ("safe", 0.0, 0.0)])
def test_empty_truth(spark, pixels, rule, with_pred, without_pred):
    none = pixels([], "row int, col int")
    for pred, want in (([(3, 3, 0.5)], with_pred), ([(3, 3, 0.0)], without_pred)):
        got = M.dti(pixels(pred), none, empty_truth=rule, eps=0.0 if rule != "zero" else 1e-12).first()
        assert got["dti"] == pytest.approx(want)


def test_groups_share_truth(spark, pixels):
    truth = pixels([(2, 2)], "row int, col int")
    pred = pixels([(1, 2, 2, 1.0), (2, 2, 3, 1.0)], "model int, row int, col int, p double")
    got = {r["model"]: r["dti"] for r in M.dti(pred, truth, by=["model"]).collect()}
    assert got[1] == pytest.approx(1.0)
    assert got[2] == pytest.approx(2 / 3, abs=1e-6)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_offsets_are_never_broadcast(spark, pixels, tmp_path):
    """The spread truth is offsets times larger than Spark believes: 49 or 709 rows a pixel filled the driver."""
    # Files, because Spark knows their size.
    pixels([(2, 3, 0.5), (9, 9, 1.0)]).write.parquet(f"{tmp_path}/pred")
    pred = spark.read.parquet(f"{tmp_path}/pred")
    truth = pred.select("row", "col")
    for out in (M.dti(pred, truth, radius=15), M.dti_box(pred, truth),
                pred.join(M.truth_reach(truth, [(0, 1, 1.0)]), ["row", "col"], "left"),
                M.spread_truth(truth, [(0, 1, 1.0)]).join(pred, ["row", "col"])):
        joins = [line for line in _plan(out).splitlines() if "Join" in line]
        assert all("SortMergeJoin" in line for line in joins)


@pytest.mark.parametrize("radius", [3, 15])
def test_tiles_meet_at_their_edges(spark, pixels, radius):
    """Coordinates on both sides of 0 and of tile edges, with a wide and a narrow kernel."""
    rng = np.random.default_rng(5)
    cells = sorted({(int(r), int(c)) for r, c in rng.integers(-20, 150, (700, 2))})
    truth = [cells[i] for i in rng.choice(len(cells), 60, replace=False)]
    pred = [(r, c, float(rng.random())) for r, c in cells]
    got = M.dti(pixels(pred), pixels(truth, "row int, col int"), radius=radius).first()
    for name, want in zip(("tp", "fp", "fn", "dti"), brute(truth, pred, float(radius))):
        assert got[name] == pytest.approx(want, abs=1e-9)


def test_groups_of_one_truth_each_count_their_misses(spark, pixels):
    truth = pixels([(2, 2), (300, 5)], "row int, col int")
    pred = pixels([("a", 2, 2, 1.0), ("b", 300, 5, 0.5), ("c", 2, 2, 0.0), (None, 2, 3, 1.0)],
                  "model string, row int, col int, p double")
    got = {r["model"]: (r["tp"], r["n_truth"]) for r in M.dti(pred, truth, by=["model"]).collect()}
    assert got["a"] == (1.0, 2) and got["b"] == (0.5, 2) and got["c"] == (0.0, 2)
    assert got[None][0] == pytest.approx(2 / 3)
