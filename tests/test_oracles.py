"""A query of every family against its SQL oracle on the smallest tables.

RASTERLOOM_ALL_ORACLES=1 runs all of them.
"""

import os

import pytest

import __spark_entry__ as entry
from rasterloom.session import get_session  # noqa: F401
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ["pixel_scan", "candidate_export", "normalized_bands", "percentile_stretch", "stencil_neighbours",
        "dti_canonical", "dti_per_block", "patch_scores", "loss_terms", "spatial_thinning", "connected_components", "final_pipeline", "group_median_imputed", "iou_thresholds",
        "sweep_power_list", "sweep_radius_only", "run_record",
        "density_clusters", "threshold_sweep", "roc_auc_and_ap", "k_curve", "raster_difference", "effect_sizes",
        "square_dilation", "tile_scoring", "radius_search", "balanced", "sweep_power_threshold_after", "sweep_thinned_k"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("RASTERLOOM_ALL_ORACLES") else SOME)
def test_oracle(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == []
