"""Thinning against the sequential visit, across tile borders."""

import numpy as np
import pytest

from rasterloom.operators import thinning as N
from rasterloom.plans.candidates import create_candidates


def sequential(scores, radius, k=None):
    h, w = scores.shape
    order = sorted(((scores[r, c], r, c) for r in range(h) for c in range(w)), reverse=True)
    used = np.zeros((h, w), dtype=bool)
    picks = []
    for _, r, c in order:
        window = (slice(max(0, r - radius), r + radius + 1), slice(max(0, c - radius), c + radius + 1))
        if used[window].any():
            continue
        used[window] = True
        picks.append((r, c))
        if k and len(picks) >= k:
            break
    return picks


def ramp(h, w):
    """Smooth slope: the longest dependency chains."""
    return np.add.outer(np.arange(h) * 1.0, np.arange(w) * 0.01) / h


@pytest.mark.parametrize("radius", [0, 1, 2])
@pytest.mark.parametrize("kind", ["random", "ties", "ramp"])
def test_matches_sequential(spark, pixels, radius, kind):
    rng = np.random.default_rng(radius)
    scores = {"random": rng.random((30, 34)), "ties": rng.integers(0, 3, (30, 34)) / 3.0,
              "ramp": ramp(30, 34)}[kind]
    got = [(r["row"], r["col"]) for r in
           N.thin(pixels(scores), radius, tile=16).orderBy("thin_rank").collect()]
    assert got == sequential(scores, radius)


def test_long_slope_is_not_stored_every_round(spark, pixels, monkeypatch):
    """Twenty tiles in a row settle one after another; undecided pixels are stored by the first round only."""
    scores = ramp(80, 12)
    kept = []
    store = N.checkpoint

    def counted(df):
        out = store(df)
        if "state" in out.columns:
            kept.append(out.count())
        return out

    monkeypatch.setattr(N, "checkpoint", counted)
    got = {(r["row"], r["col"]) for r in N.thin(pixels(scores), 1, ranked=False, tile=4).collect()}
    assert got == set(sequential(scores, 1))
    assert len(kept) > 10 and sum(kept) <= 2 * scores.size


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sparse_clusters_across_corners(spark, pixels, seed):
    """Gaps, ties and picks two windows away, with tiles as small as a window."""
    rng = np.random.default_rng(seed)
    scores = np.maximum(ramp(33, 29), rng.integers(0, 8, (33, 29)) / 8.0)
    hole = rng.random(scores.shape) < 0.4
    data = [(r, c, float(scores[r, c])) for r in range(33) for c in range(29) if not hole[r, c]]
    got = {(r["row"], r["col"]) for r in N.thin(pixels(data), 2, ranked=False, tile=4).collect()}
    left = np.where(hole, -1.0, scores)
    assert got == {(r, c) for r, c in sequential(left, 2) if not hole[r, c]}


def test_first_k_is_exact_prefix(spark, pixels):
    scores = np.random.default_rng(5).random((40, 40))
    got = [(r["row"], r["col"]) for r in N.thin(pixels(scores), 1, 25).orderBy("thin_rank").collect()]
    assert got == sequential(scores, 1, 25)


def test_large_k_uses_global_rank(spark, pixels, monkeypatch):
    from rasterloom.operators import ordering
    monkeypatch.setattr(ordering, "_TAKE", 5)
    scores = np.random.default_rng(6).random((30, 30))
    got = [(r["row"], r["col"]) for r in N.thin(pixels(scores), 1, 20).orderBy("thin_rank").collect()]
    assert got == sequential(scores, 1, 20)


def test_all_scores_equal(spark, pixels):
    scores = np.full((20, 20), 0.5)
    assert N.thin(pixels(scores), 1, 10).count() == 10


def test_parameter_guards(spark, pixels):
    df = pixels([(0, 0, 0.5)])
    for bad in (dict(k=0, power=1.0, radius=0), dict(k=1, power=0.0, radius=0), dict(k=1, power=1.0, radius=-1)):
        with pytest.raises(ValueError):
            create_candidates(df, **bad)
    with pytest.raises(ValueError):
        create_candidates(pixels([(0, 0, 0.0)]), 1, 1.0, 0)
