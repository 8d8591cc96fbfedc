"""Components and clusters against plain sequential versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import components as C


def flood(points, near):
    """Component id (smallest member) per point."""
    left, label = set(points), {}
    for p in sorted(points):
        if p in label:
            continue
        stack = [p]
        label[p] = p
        while stack:
            a = stack.pop()
            for b in left:
                if b not in label and near(a, b):
                    label[b] = p
                    stack.append(b)
    return label


def spiral(n):
    """One long winding line: many tile crossings in a row."""
    pts, r, c, step = [], n // 2, n // 2, 1
    while 0 <= r < n and 0 <= c < n:
        for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            for _ in range(step):
                if 0 <= r < n and 0 <= c < n:
                    pts.append((r, c))
                r, c = r + dr, c + dc
            if dr == 0 and dc == 0:
                break
            if dc == 0:
                step += 2
    return sorted(set(pts))


@pytest.mark.parametrize("kind", ["sparse", "dense", "spiral"])
def test_components(spark, pixels, kind):
    rng = np.random.default_rng(3)
    if kind == "spiral":
        pts = spiral(24)
    else:
        pts = [tuple(map(int, p)) for p in np.argwhere(rng.random((24, 26)) < (0.25 if kind == "sparse" else 0.5))]
    want = flood(pts, lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1)
    rows = C.connected_components(pixels(pts, "row int, col int"), tile=8).collect()
    got = {(r["row"], r["col"]): (r["root"] >> 31, r["root"] & ((1 << 31) - 1)) for r in rows}
    assert got == want


def sequential_dbscan(points, eps, least):
    """Points in visiting order; the usual queue-based algorithm."""
    near = [[j for j, b in enumerate(points) if math.hypot(a[0] - b[0], a[1] - b[1]) <= eps] for a in points]
    label = [None] * len(points)
    cluster = -1
    for i in range(len(points)):
        if label[i] is not None or len(near[i]) < least:
            continue
        cluster += 1
        queue = [i]
        label[i] = cluster
        while queue:
            a = queue.pop(0)
            if len(near[a]) < least:
                continue
            for b in near[a]:
                if label[b] is None:
                    label[b] = cluster
                    queue.append(b)
    return [-1 if x is None else x for x in label]


@pytest.mark.parametrize("density", [0.08, 0.2])
def test_dbscan(spark, density):
    rng = np.random.default_rng(8)
    pts = [tuple(map(int, p)) for p in np.argwhere(rng.random((36, 36)) < density)]
    order = rng.permutation(len(pts))
    pts = [pts[i] for i in order]
    want = sequential_dbscan(pts, 3.0, 5)
    df = spark.createDataFrame([(r, c, i + 1) for i, (r, c) in enumerate(pts)], "row int, col int, rank long")
    got = {(r["row"], r["col"]): r["cluster_id"] for r in C.dbscan(df, 300.0, 5, 100.0, tile=16).collect()}
    assert [got[p] for p in pts] == want


def test_merge_labels_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in C.merge_labels(edges).collect()} == {0}
