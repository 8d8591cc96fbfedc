"""Exact-count sampling, balancing, splits and negative mining.

Draws are ordered by a hash of the pixel, so they are uniform, repeatable and
independent of partitioning.  Exact counts come from ``top_k``, which never
gathers a large sample in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .grid import VALIDATION_BLOCKS, block_of, border_safe, split_of, with_split_distance
from .metric import truth_reach
from .ordering import best_first, few, global_rank, match_null_safe, running_counts, top_k
from ..functions.kernels import disc


def hash_key(seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), F.col("row"), F.col("col"))


def sample_exact(df: DataFrame, n: int, key: Column | None = None, seed: int = 42) -> DataFrame:
    """min(n, population) rows without replacement."""
    key = key if key is not None else hash_key(seed)
    # Complemented, so that the draw is the head of a descending order.
    return top_k(df.withColumn("_k", F.bitwise_not(key.cast("long"))), n, [F.col("_k").desc(), F.col("row").asc(), F.col("col").asc()],
                 lead="_k").drop("_k")


def shuffle_order(df: DataFrame, key: Column | None = None, seed: int = 42,
                  name: str = "position") -> DataFrame:
    """Random order as a position column."""
    key = key if key is not None else hash_key(seed)
    return global_rank(df.withColumn("_k", key), [F.col("_k").asc(), F.col("row").asc(),
                                                  F.col("col").asc()], name).drop("_k")


def balance(df: DataFrame, ratio: float = 1.0, key: Column | None = None, seed: int = 42) -> DataFrame:
    """All positives (label > 0) and at most ratio * positives negatives."""
    pos, neg = df.filter("label > 0"), df.filter("label <= 0")
    quota = int(pos.count() * ratio)
    return pos if quota == 0 else pos.unionByName(sample_exact(neg, quota, key, seed))


def balance_symmetric(df: DataFrame, key: Column | None = None, seed: int = 42) -> DataFrame:
    """min(pos, neg) rows of each class; raises when a class is empty."""
    counts = df.agg(F.count(F.when(F.col("label") > 0, 1)), F.count(F.when(F.col("label") <= 0, 1))).first()
    n = min(counts)
    if n == 0:
        raise ValueError("balancing needs both classes")
    return sample_exact(df.filter("label > 0"), n, key, seed).unionByName(
        sample_exact(df.filter("label <= 0"), n, key, seed))


def stratified(df: DataFrame, stratum: str, quotas: dict, key: Column | None = None,
               seed: int = 42, strict: bool = False) -> DataFrame:
    """At most ``quotas[s]`` rows of each stratum; ``strict`` raises when one is short."""
    parts = [sample_exact(df.filter(F.col(stratum) == s), n, key, seed) for s, n in quotas.items()]
    if strict:
        have = dict(df.groupBy(stratum).count().filter(F.col(stratum).isin(*quotas)).collect())
        short = {s: have.get(s, 0) for s, n in quotas.items() if have.get(s, 0) < n}
        if short:
            raise ValueError(f"too few rows in {short}, wanted {quotas}")
    return reduce(DataFrame.unionByName, parts)


def split_fraction(df: DataFrame, label: str, fraction: float = 0.2, key: Column | None = None,
                   seed: int = 42) -> DataFrame:
    """Stratified split: ceil(fraction * n) rows of each label become "test"; NULL is a label, too."""
    key = key if key is not None else hash_key(seed)
    keyed = df.withColumn("_k", key).withColumn("_one", F.lit(1))
    placed = running_counts(keyed, [F.col(label).asc(), F.col("_k").asc(), F.col("row").asc(),
                                    F.col("col").asc()], {"_cum": "_one"})
    # One row per label value.
    sizes = placed.groupBy(label).agg(F.max("_cum").alias("_last"), F.count(F.lit(1)).alias("_size"))
    inside = F.col("_cum") - (F.col("_last") - F.col("_size"))
    return (match_null_safe(placed, few(sizes), [label])
            .withColumn("split", F.when(inside <= F.ceil(F.col("_size") * fraction), F.lit("test"))
                        .otherwise(F.lit("train")))
            .drop("_k", "_one", "_cum", "_last", "_size"))


def random_blocks(n_blocks: int = 16, fraction: float = 0.25, seed: int = 42) -> tuple[int, ...]:
    """Seeded draw of max(1, int(n * fraction)) validation blocks."""
    import random
    return tuple(sorted(random.Random(seed).sample(range(n_blocks), max(1, int(n_blocks * fraction)))))


def leak_safe(df: DataFrame, height: int, width: int, good: Column, margin: int = 15,
              validation: Sequence[int] = VALIDATION_BLOCKS) -> DataFrame:
    """Pixels whose (2*margin+1) patch stays in the raster and in its own split."""
    validation = tuple(validation)
    train = tuple(b for b in range(16) if b not in validation)
    block = block_of(height, width)
    safe = df.filter(border_safe(height, width, margin) & good)
    to = with_split_distance(with_split_distance(safe, height, width, train, "_t"), height, width, validation, "_v")
    other = F.when(block.isin(*validation), F.col("_t")).otherwise(F.col("_v"))
    return (to.filter(other > margin).drop("_t", "_v")
            .withColumn("block_id", block).withColumn("split", split_of(block, validation)))


def distance_to_truth(pixels: DataFrame, truth: DataFrame, limit: float) -> DataFrame:
    """Append ``truth_distance``: Euclidean distance if <= limit, else NULL."""
    # The reach keeps the largest weight; limit - d turns that into the nearest d.
    near = truth_reach(truth, [(dy, dx, limit - d) for dy, dx, d in disc(limit)])
    return (pixels.join(near, ["row", "col"], "left")
            .withColumn("truth_distance", F.lit(float(limit)) - F.col("influence")).drop("influence"))


def hard_negatives(scored: DataFrame, height: int, width: int, *, min_score: float = 0.3,
                   truth_gap: float = 5.0, margin: int = 15, n: int = 100_000,
                   validation: Sequence[int] = VALIDATION_BLOCKS) -> DataFrame:
    """Confident false alarms of the training blocks, best n by score.

    ``scored``: row, col, p, label, valid.  Far from the raster edge, more than
    ``margin`` from validation blocks and at least ``truth_gap`` from any truth.
    """
    validation = tuple(validation)
    truth = scored.filter("label > 0").select("row", "col")
    pool = scored.filter(
        ~block_of(height, width).isin(*validation) & border_safe(height, width, margin)
        & F.col("valid") & (F.col("label") <= 0) & (F.col("p") >= min_score))
    pool = with_split_distance(pool, height, width, validation, "_v").filter(F.col("_v") > margin).drop("_v")
    far = distance_to_truth(pool, truth, truth_gap).filter(
        F.col("truth_distance").isNull() | (F.col("truth_distance") >= truth_gap))
    return top_k(far.select("row", "col", "p"), n, best_first(), lead="p")


def near_negatives(pixels: DataFrame, truth: DataFrame, limit: float = 3.0) -> DataFrame:
    """Background pixels within ``limit`` of training truth, with their distance."""
    return distance_to_truth(pixels.filter("label <= 0"), truth, limit).filter(
        (F.col("truth_distance") > 0) & (F.col("truth_distance") <= limit))


def score_band(p: Column) -> Column:
    """Band of a mined negative; NULL below 0.6."""
    return (F.when(p >= 0.9, F.lit("0.9+")).when(p >= 0.8, F.lit("0.8-0.9"))
            .when(p >= 0.7, F.lit("0.7-0.8")).when(p >= 0.6, F.lit("0.6-0.7")))
