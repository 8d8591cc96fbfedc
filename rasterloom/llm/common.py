"""Helpers shared by the operators: clean inputs, shared storage, labelled samples, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint

__all__ = ["checkpoint", "table", "unused", "shared_folder", "Tables", "fold", "labelled_sample", "slices",
           "flat_words", "mix", "powers", "ascii_lower", "fit_logistic", "sigmoid"]

#: A-Z and a-z, for lower-casing that leaves all other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which driver and executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        checkpoint(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


class Tables:
    """Tables of an iterative operator in the shared folder; a new version replaces the old one's files."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Store ``df`` and drop what was stored under ``name`` before; nothing lazy may read that any more."""
        path = shared_folder(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, prefix: str = "_") -> str:
    """A column prefix that no column of ``df`` starts with."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")), F.lit(0)) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int,
                    keep: Column | None = None) -> DataFrame:
    """doc_id, text, y of at most about ``limit`` labelled rows, chosen by a hash of doc_id.

    ``keep`` filters the labels (column doc_id).  Rows without label or text are not
    used; a doc_id with both labels counts as 1.  The bound holds in expectation and
    is cut at 1.1 times ``limit``.  The labels side has that proven bound and is broadcast.
    Where doc_ids repeat so often that their rows exceed it, equal rows count once and the
    others are thinned by a hash of the text to the same bound.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y is not null and doc_id is not null")
    if keep is not None:
        known = known.filter(keep)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > limit:
        span = 1 << 30
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(span * limit / n))
    most = int(1.1 * limit) + 1
    known = known.limit(most)
    texts = docs.select("doc_id", "text").filter("text is not null")
    chosen = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    rows = chosen.select("doc_id").count()
    if rows > most:
        chosen = chosen.dropDuplicates(["doc_id", "text"])
        rows = chosen.count()
        span = 1 << 30
        chosen = chosen.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(span)) < int(span * min(1.0, limit / max(rows, 1)))).limit(most)
    return chosen


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) row ranges of a string column with about ``most`` bytes each, one row at least."""
    start, size = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x5851F42D4C957F2D)
_BYTE = mix(np.arange(256, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        jump = int(out[filled - 1]) * int(base) % (1 << 64)
        out[filled:filled + step] = out[:step] * np.uint64(jump)
        filled += step
    return out


def flat_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space) and the word count per text."""
    raw = b" ".join((t or "").encode() for t in texts) + b" "
    if lower:
        raw = raw.translate(_FOLD_BYTES)
    data = np.frombuffer(raw, np.uint8)
    blank = _SPACE[data]
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
    # Powers grow with the position; divided by that of the first byte, equal words get equal sums.
    value = (total[ends] - total[starts]) * powers(len(data) + 1, _INVERSE)[starts]
    hashes = mix(value ^ (ends - starts).astype(np.uint64))
    sizes = np.fromiter((len((t or "").encode()) + 1 for t in texts), np.int64, len(texts))
    stops = np.cumsum(sizes)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, stops))))
    return hashes, counts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton steps of a small dense logistic regression; the last weight is the intercept.

    With no rows or one class, the Laplace-smoothed share of that class is all it knows.
    """
    x = np.asarray(x, float)
    x = np.column_stack([x.reshape(len(y), x.shape[1] if x.ndim > 1 else 1), np.ones(len(y))])
    w = np.zeros(x.shape[1])
    share = (np.sum(y) + 1.0) / (len(y) + 2.0)
    w[-1] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return w
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) / len(y) + ridge * np.append(w[:-1], 0)
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
