"""Connected components and density clusters of lattice points.

Components are labelled inside tiles with array code, labels that meet in a halo
are merged by a small label graph, and only that graph is iterated in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kernels import box, disc
from ..session import checkpoint
from .ordering import few, global_rank, percentiles_wide
from .tiles import TILE, focal, map_tiles

_COL_BITS = 31
_FEW_ROOTS = 100_000    # roots up to which their table is broadcast
_SALT = 16              # tasks among which a root's nodes are dealt out beyond


def _key(row, col):
    """Row-major order of a pixel as one long."""
    return F.shiftleft(row.cast("long"), _COL_BITS).bitwiseOR(col.cast("long"))


def _local_labels(tile: int, halo: int, half: Sequence[tuple[int, int]]):
    def run(pdf: pd.DataFrame, row0: int, col0: int) -> pd.DataFrame:
        rows, cols = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        order = np.lexsort((cols, rows))
        rows, cols = rows[order], cols[order]
        y, x = rows - (row0 - halo), cols - (col0 - halo)
        side = tile + 2 * halo
        index = np.full((side, side), -1, dtype=np.int32)
        index[y, x] = np.arange(len(rows), dtype=np.int32)
        label = np.arange(len(rows), dtype=np.int32)
        changed = True
        while changed:
            before = label.copy()
            for dy, dx in half:
                a = index[max(0, -dy):side - max(0, dy), max(0, -dx):side - max(0, dx)]
                b = index[max(0, dy):side - max(0, -dy), max(0, dx):side - max(0, -dx)]
                both = (a >= 0) & (b >= 0)
                u, v = a[both], b[both]
                low = np.minimum(label[u], label[v])
                np.minimum.at(label, label[u], low)   # hook the roots as well
                np.minimum.at(label, label[v], low)
                np.minimum.at(label, u, low)
                np.minimum.at(label, v, low)
            while True:
                jump = label[label]
                if (jump == label).all():
                    break
                label = jump
            changed = bool((before != label).any())
        first = label.astype(np.int64)
        key = (rows[first] << _COL_BITS) | cols[first]
        own = (y >= halo) & (y < halo + tile) & (x >= halo) & (x < halo + tile)
        return pd.DataFrame({"row": rows.astype("int32"), "col": cols.astype("int32"),
                             "label": key, "own": own})

    return run


def _jump(hooked: DataFrame) -> DataFrame:
    """Each node's root replaced by that root's root where it is smaller.

    A root may be that of half the nodes.  The other side has one row per distinct root: it is
    broadcast while that is few, and beyond dealt out to _SALT tasks per root.
    """
    roots = hooked.select("root").distinct()
    parent = (hooked.withColumnRenamed("root", "up").join(roots.withColumnRenamed("root", "node"), "node", "left_semi")
              .withColumnRenamed("node", "root"))
    if parent.count() <= _FEW_ROOTS:
        met = hooked.join(F.broadcast(parent), "root", "left")
    else:
        salted = hooked.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(_SALT)).cast("int"))
        copies = parent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
        met = salted.join(copies, ["root", "_salt"], "left")
    return met.select("node", F.least("root", F.coalesce("up", "root")).alias("root"))


def merge_labels(edges: DataFrame) -> DataFrame:
    """Smallest reachable label per node of an undirected graph (a, b): node, root.

    Min-label hooking with pointer jumping; each round is checkpointed, and rounds
    grow with the logarithm of the longest chain.  Minima are taken with partial
    aggregation, so a label shared by a third of the nodes is no hot spot.
    """
    both = checkpoint(edges.select("a", "b").filter("a <> b").distinct())
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = checkpoint(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
                       .withColumnRenamed("a", "node"))
    while True:
        near = (both.join(roots.withColumnRenamed("node", "b"), "b")
                .groupBy("a").agg(F.min("root").alias("near")))
        seen = roots.join(near, roots["node"] == near["a"]).select("node", "root", "near")
        # Offer the smaller label to the node and to its current root.
        offers = (seen.select("node", F.least("root", "near").alias("root"))
                  .unionByName(seen.filter("near < root")
                               .select(F.col("root").alias("node"), F.col("near").alias("root"))))
        hooked = checkpoint(offers.groupBy("node").agg(F.min("root").alias("root")))
        fresh = checkpoint(_jump(hooked))
        moved = fresh.join(roots.withColumnRenamed("root", "old"), "node").filter("root < old")
        if moved.isEmpty():
            return fresh
        roots = fresh


def label_points(points: DataFrame, offsets: Sequence[tuple[int, int, float]],
                 tile: int = TILE) -> DataFrame:
    """Components of unique lattice points joined by ``offsets``.

    Returns row, col, ``root`` = row-major key of the component's first pixel.
    """
    halo = max(max(abs(o[0]), abs(o[1])) for o in offsets)
    half = [(dy, dx) for dy, dx, _ in offsets if dy > 0 or (dy == 0 and dx > 0)]
    labelled = checkpoint(map_tiles(
        points.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")),
        _local_labels(tile, halo, half), "row int, col int, label long, own boolean", tile, halo))
    own = labelled.filter("own").drop("own")
    meet = (labelled.filter("not own").select("row", "col", F.col("label").alias("b"))
            .join(own.withColumnRenamed("label", "a"), ["row", "col"]).select("a", "b"))
    roots = merge_labels(meet)
    # A tile label covers at most one tile, so this key has no hot value.
    return (own.join(roots, own["label"] == roots["node"], "left")
            .select("row", "col", F.coalesce("root", "label").alias("root")))


def connected_components(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """8-connected components of the given pixels: row, col, root."""
    return label_points(mask, box(1), tile)


def component_sizes(labelled: DataFrame, n: int = 20) -> DataFrame:
    """Largest components: size_rank, first_row, first_col, size."""
    order = [F.col("size").desc(), F.col("root").asc()]
    top = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("size")).orderBy(*order).limit(n)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("size_rank"),
        F.shiftright("root", _COL_BITS).cast("int").alias("first_row"),
        F.col("root").bitwiseAND(F.lit((1 << _COL_BITS) - 1)).cast("int").alias("first_col"),
        "size")


def dbscan(points: DataFrame, eps: float, min_samples: int, res: float = 1.0,
           order: str = "rank", tile: int = TILE) -> DataFrame:
    """DBSCAN of unique lattice points (row, col, ``order``) with spacing ``res``.

    A point counts itself.  Clusters are numbered by the first core point in
    ``order``; a border point takes the lowest cluster among its core neighbours;
    noise is -1.  Columns: row, col, is_core, cluster_id.
    """
    near = disc(eps / res)
    ones = points.select("row", "col", F.lit(1.0).alias("one"))
    counts = focal(ones, "one", how="sum", offsets=near, name="neighbours", tile=tile)
    flagged = checkpoint(points.select(F.col("row").cast("int").alias("row"),
                                       F.col("col").cast("int").alias("col"), order)
                         .join(counts, ["row", "col"])
                         .withColumn("is_core", F.col("neighbours") >= min_samples))
    core = flagged.filter("is_core")
    rooted = label_points(core, near, tile).join(core.select("row", "col", order), ["row", "col"])
    firsts = rooted.groupBy("root").agg(F.min(order).alias("_first"))
    numbered = (global_rank(firsts, [F.col("_first").asc()], "_n")
                .select("root", (F.col("_n") - 1).alias("cluster_id")))
    # One cluster can hold most points; the cluster table is broadcast while it is few.
    clustered = rooted.join(few(checkpoint(numbered)), "root").select("row", "col", "cluster_id")
    # Stored, so that later passes over the clusters do not repeat the tile work.
    all_ids = checkpoint(flagged.select("row", "col", "is_core").join(clustered, ["row", "col"], "left"))
    reached = focal(all_ids, "cluster_id", how="min", offsets=near, name="near_id", tile=tile)
    return checkpoint(all_ids.join(reached, ["row", "col"])
                      .select("row", "col", "is_core",
                              F.coalesce("cluster_id", F.col("near_id").cast("long"), F.lit(-1))
                              .cast("long").alias("cluster_id")))


def cluster_summary(points: DataFrame) -> DataFrame:
    """One row per cluster: count, score statistics, centre, bounding box, area.

    ``points``: cluster_id, p, x, y, longitude, latitude; noise (-1) is left out.
    """
    member = points.filter("cluster_id >= 0")
    # A cluster may hold most of the points, so its percentiles come from the
    # range-partitioned order, not from an aggregate that keeps a group in one task.
    pct = percentiles_wide(member, "p", {"median_probability": 0.5, "p90_probability": 0.90,
                                         "p95_probability": 0.95}, ["cluster_id"])
    base = member.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.avg("p").alias("mean_probability"),
        F.max("p").alias("max_probability"), F.avg("x").alias("center_x_m"), F.avg("y").alias("center_y_m"),
        F.avg("longitude").alias("center_longitude"), F.avg("latitude").alias("center_latitude"),
        F.min("x").alias("min_x_m"), F.max("x").alias("max_x_m"), F.min("y").alias("min_y_m"),
        F.max("y").alias("max_y_m"))
    width, height = F.col("max_x_m") - F.col("min_x_m"), F.col("max_y_m") - F.col("min_y_m")
    return (base.join(pct, "cluster_id").withColumn("width_m", width).withColumn("height_m", height)
            .withColumn("approx_bbox_area_km2", F.col("width_m") * F.col("height_m") / 1_000_000.0))


def cluster_best(points: DataFrame) -> DataFrame:
    """Best member of each cluster; the better rank wins ties."""
    best = F.max_by(F.struct("rank", "row", "col", "p"), F.struct(F.col("p"), -F.col("rank")))
    return (points.filter("cluster_id >= 0").groupBy("cluster_id").agg(best.alias("b"))
            .select("cluster_id", "b.*"))


def cluster_sizes(points: DataFrame) -> DataFrame:
    """Clustered and noise counts, number of clusters, size statistics, clustered share."""
    sizes = points.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    real = F.when(F.col("cluster_id") >= 0, F.col("n"))
    median = percentiles_wide(sizes.filter("cluster_id >= 0"), "n", {"m": 0.5}).scalar()
    return sizes.agg(
        F.sum(real).alias("clustered"),
        F.coalesce(F.sum(F.when(F.col("cluster_id") < 0, F.col("n"))), F.lit(0)).alias("noise"),
        F.count(real).alias("clusters"), F.min(real).alias("smallest"), F.max(real).alias("largest"),
        F.avg(real).alias("mean_size"), (F.sum(real) * 100.0 / F.sum("n")).alias("clustered_percent")
    ).withColumn("median_size", median)


def in_largest_clusters(points: DataFrame, n: int) -> DataFrame:
    """Members of the n largest clusters (lower id wins ties)."""
    top = (points.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.col("_n").desc(), "cluster_id").limit(n).select("cluster_id"))
    return points.join(F.broadcast(top), "cluster_id", "left_semi")   # n rows
