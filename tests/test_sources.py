"""Readers and writers round trip."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.geo import SURVEY_GEO
from rasterloom.operators.grid import raster_corners, raster_profile
from rasterloom.plans.candidates import candidate_table
from rasterloom.sources import tables as S


@pytest.fixture
def candidates(pixels):
    return candidate_table(pixels(np.random.default_rng(0).random((20, 20))), 12, 0.001, 1, SURVEY_GEO)


def test_candidate_csv(spark, candidates, tmp_path):
    path = str(tmp_path / "c")
    S.write_csv(S.candidate_export(candidates), path, ["rank"])
    back = S.read_candidates(spark, path)
    assert back.schema["rank"].dataType.simpleString() == "int"
    a, b = candidates.orderBy("rank").collect(), back.orderBy("rank").collect()
    assert len(a) == len(b) == 12
    for x, y in zip(a, b):
        assert y["raw_model_probability"] == pytest.approx(x["raw_model_probability"], abs=1e-9)
        assert y["latitude"] == pytest.approx(x["latitude"], abs=1e-8)


def test_missing_columns_are_named(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.range(2).select(F.col("id").alias("rank")).write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="latitude"):
        S.read_candidates(spark, path)


def test_geojson(spark, tmp_path):
    path = tmp_path / "c.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-118.5, 39.25]},
         "properties": {"rank": 1, "row": 5, "column": 6, "score": 0.75, "x": 1.0, "y": 2.0}}]}, indent=1))
    row = S.read_geojson(spark, str(path)).first()
    assert (row["rank"], row["column"], row["score"], row["longitude"], row["latitude"]) == (1, 6, 0.75, -118.5, 39.25)


def test_strips_prune(spark, pixels, tmp_path):
    path = str(tmp_path / "strips")
    S.write_strips(pixels(np.random.default_rng(1).random((40, 8))), path, rows=10)
    part = S.read_strips(spark, path, 12, 20, rows=10)
    assert part.count() == 8 * 8
    assert "PartitionFilters: [isnotnull(strip" in part._jdf.queryExecution().toString()


def test_layer_metadata(spark, pixels, tmp_path):
    prof = raster_profile(pixels(np.zeros((4, 5))), ["a", "b"], SURVEY_GEO)
    text = S.layer_metadata(prof, raster_corners(prof, SURVEY_GEO), [(1, "a", "first"), (2, "b", "second")],
                            "in.tif", SURVEY_GEO).first()["metadata"]
    (tmp_path / "layers.json").write_text(text)
    rows = S.read_layer_metadata(spark, str(tmp_path / "layers.json")).orderBy("index").collect()
    assert [r["name"] for r in rows] == ["a", "b"] and rows[0]["width"] == 5
    assert set(json.loads(text)["corners"]) == {"topLeft", "topRight", "bottomRight", "bottomLeft"}


def test_run_record_written(spark, candidates, tmp_path):
    S.run_record(candidates, k=12, power=0.001).write.json(str(tmp_path / "run"))
    got = spark.read.json(str(tmp_path / "run")).first()
    assert got["selected"] == 12 and got["k"] == 12
