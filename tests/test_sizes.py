"""What a task holds does not grow with the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import ordering as O
from rasterloom.plans import models as ML


def test_ranked_partitions_stay_small_where_the_rows_are_known(spark, monkeypatch):
    monkeypatch.setattr(O, "_SORTED", 50)
    df = spark.range(2000).select("id", (F.col("id") * 7 % 40).cast("double").alias("v"), (F.col("id") % 3).cast("int").alias("g"))
    out = O.with_average_ranks(df, "v", ["g"], ["id"], rows=2000)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 500                             # four partitions of 500 without the number
    rows = out.collect()
    for g in range(3):
        v = np.array([r["v"] for r in rows if r["g"] == g])
        got = np.array([r["avg_rank"] for r in rows if r["g"] == g])
        want = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        assert got == pytest.approx(want)


def test_ablation_stores_no_scores(spark, pixels, monkeypatch):
    def refuse(df):
        raise AssertionError("stored")

    monkeypatch.setattr(ML, "checkpoint", refuse)
    df = pixels([(0, 0, 1.0, 0.2), (5, 5, 0.5, 0.4)], "row int, col int, a double, b double")
    truth = df.filter("row = 0").select("row", "col")
    out = ML.ablation_importance(df, ["a", "b"], truth, lambda d: d.withColumn("p", F.col("a") * 0.5 + F.col("b"))).collect()
    def score(tp, fp):
        return tp / (tp + 0.2 * fp + 0.8 * (1 - tp) + 1e-12)
    got = {r["feature"]: (r["baseline_dti"], r["ablated_dti"]) for r in out}
    assert got["a"] == pytest.approx((score(0.7, 0.65), score(0.2, 0.4)))
    assert got["b"] == pytest.approx((score(0.7, 0.65), score(0.5, 0.25)))
