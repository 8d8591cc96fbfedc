"""Vector codes by parts: codebooks fitted with a lexicographic trie over distinct parts.

Components become integers, vectors are cut into equal parts, and every part position has a
codebook.  The distinct parts of the table are counted, range-sorted by (position, components)
and stored once.  A task reads a stretch of that order, which is a trie in depth-first order:
parts with a common prefix of dimensions share the vector of distances that all codebook
entries have gathered along it.  Leaves take the nearest entry and add their weighted
components to its sum.  Only entries x dimensions sums leave a task, so a round moves no part.

Below BUSH leaves a subtree is walked level by level on arrays, still one distance vector per
distinct prefix; above, children are visited depth first from a stack.

Defined results: rows without a vector, without components or with a null or non-finite one
are dropped; so are vectors that cannot be cut into equal parts or that are not as long as the
vector of the smallest id, and those with a component beyond +-32768, where squared distances
leave 64 bits.  Rows without id are coded, but start no codebook; of rows with equal ids the
smallest vector starts one.  With fewer ids than entries the codebooks are shorter; equal
entries lose to the first of them.  Repeated rows are all returned and weigh as many.  Null
labels count as one label.  An empty table gives no rows.  Other columns never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import few
from .common import checkpoint, shared_folder, table
from .registry import query

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST = 1 << 27              # largest integer component
BUSH = 1024                 # leaves of a subtree that is walked level by level
_BIAS = 1 << 31             # makes the byte order of stored components their number order

Books = list[np.ndarray]    # per part position: entries x dimensions


def integer_vectors(vectors: DataFrame, vector: str, scale: int, *keep: str) -> DataFrame:
    """``keep`` and cells (array<int>) of the rows whose vector has finite components."""
    x = F.col(vector)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale <= MOST - 1))
    return (vectors.filter(x.isNotNull() & (F.size(x) > 0) & F.coalesce(good, F.lit(False)))
            .select(*keep, F.transform(x, lambda c: F.floor(c.cast("double") * scale).try_cast("int")).alias("cells")))


def first_vectors(cells: DataFrame, name: str, n: int) -> list[list[int]]:
    """The vectors of the ``n`` smallest distinct ids, ascending; n passes at most, n rows each."""
    found: list[list[int]] = []
    last = None
    while len(found) < n:
        rest = cells.filter(F.col(name).isNotNull() if last is None else F.col(name) > F.lit(last))
        rows = rest.select(name, "cells").orderBy(name, "cells").limit(n).collect()
        if not rows:
            break
        for row in rows:
            if row[0] != last:
                found.append(list(row["cells"]))
                last = row[0]
    return found[:n]


# -- the trie ---------------------------------------------------------------------------

def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``rows`` lexicographically, and where a new one begins in it."""
    order = np.lexsort(rows.T[::-1])
    ranked = rows[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    return order, fresh


def nearest(leaves: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties: the first) and squared distance of sorted distinct ``leaves``."""
    code, error = np.zeros(len(leaves), np.int64), np.zeros(len(leaves), np.int64)
    stack = [(0, len(leaves), 0, np.zeros((1, len(book)), np.int64))]
    while stack:
        low, high, depth, gathered = stack.pop()
        if high - low <= BUSH or depth == leaves.shape[1]:
            _bush(leaves, book, low, high, depth, gathered, np.zeros(high - low, np.int64), code, error)
            continue
        column = leaves[low:high, depth]
        heads = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        ends = np.append(heads[1:], high - low)
        children = gathered + (column[heads, None] - book[None, :, depth]) ** 2
        visits = []
        k = 0
        while k < len(heads):       # small neighbours are walked together, each from its own node
            stop = max(k + 1, int(np.searchsorted(ends, heads[k] + BUSH, "right")))
            visits.append((k, stop))
            k = stop
        for k, stop in reversed(visits):
            start, end = low + int(heads[k]), low + int(ends[stop - 1])
            if stop == k + 1:
                stack.append((start, end, depth + 1, children[k:stop]))
            else:
                node = np.repeat(np.arange(stop - k), ends[k:stop] - heads[k:stop])
                _bush(leaves, book, start, end, depth + 1, children[k:stop], node, code, error)
    return code, error


def _bush(leaves, book, low, high, depth, gathered, node, code, error) -> None:
    """Leaves low..high below the nodes ``gathered``; ``node`` names the one of each leaf."""
    part = leaves[low:high]
    fresh = np.append(True, node[1:] != node[:-1]) if len(node) else np.zeros(0, bool)
    for d in range(depth, leaves.shape[1]):
        fresh[1:] |= part[1:, d] != part[:-1, d]
        heads = np.flatnonzero(fresh)
        gathered = gathered[node[heads]] + (part[heads, d, None] - book[None, :, d]) ** 2
        node = np.cumsum(fresh) - 1
    best = gathered.argmin(axis=1)
    code[low:high] = best[node]
    error[low:high] = gathered[np.arange(len(best)), best][node]


# -- counting and storing distinct parts ------------------------------------------------

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def distinct_parts(cells: DataFrame, dimensions: int, parts: int) -> DataFrame:
    """part, key, n in the order of (part, key): key spells the components so that bytes sort as numbers."""
    width = dimensions // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(0), dimensions)
            for p in range(parts if len(rows) else 0):
                own = rows[:, p * width:(p + 1) * width]
                order, fresh = _distinct(own)
                heads = np.flatnonzero(fresh)
                raw = (own[order[heads]] + _BIAS).astype(">u4").tobytes()
                keys = pa.Array.from_buffers(pa.binary(4 * width), len(heads), [None, pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(heads), p, np.int32)), keys.cast(pa.binary()),
                     pa.array(np.diff(np.append(heads, len(rows))))], ["part", "key", "n"])

    # Counted within batches and again before the shuffle: a vector that a third of the rows share is one row.
    counted = (cells.select("cells").mapInArrow(run, "part int, key binary, n long")
               .groupBy("part", "key").agg(F.sum("n").alias("n")))
    path = shared_folder(cells.sparkSession, "parts")
    counted.repartitionByRange("part", "key").sortWithinPartitions("part", "key").write.parquet(path)
    return cells.sparkSession.read.parquet(path)


def _weighted(weights: np.ndarray, code: np.ndarray, leaves: np.ndarray, entries: int) -> tuple[list, list]:
    """Per entry: weight, and weighted sum of each component, as exact integers."""
    largest = int(np.abs(leaves).max(initial=0)) + 1
    if int(weights.sum()) * largest >= 1 << 62:
        weights, leaves = weights.astype(object), leaves.astype(object)
    counts = np.zeros(entries, weights.dtype)
    np.add.at(counts, code, weights)
    sums = np.zeros((entries, leaves.shape[1]), leaves.dtype)
    np.add.at(sums, code, weights[:, None] * leaves)
    return counts.tolist(), sums.tolist()


def _round(stored: DataFrame, books: Books) -> Books:
    """Codebooks after one round over the stored parts."""
    width, entries = books[0].shape[1], len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            position = batch.column(0).to_numpy()
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, width).astype(np.int64) - _BIAS
            weights = batch.column(2).to_numpy()
            for p in np.unique(position).tolist():
                at = position == p
                leaves = keys[at]
                code, _ = nearest(leaves, books[p])
                counts, sums = _weighted(weights[at], code, leaves, entries)
                for e in range(entries):
                    if counts[e]:
                        for i, v in enumerate((counts[e], *sums[e])):
                            total[p, e, i] = total.get((p, e, i), 0) + v
        names = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[j] for k in names], pa.int32()) for j in range(3)]
            + [pa.array([Decimal(total[k]) for k in names], pa.decimal128(38, 0))], ["part", "entry", "at", "total"])

    # parts x entries x (dimensions + 1) rows at most, from every task and to the driver.
    rows = (stored.mapInArrow(run, "part int, entry int, at int, total decimal(38,0)")
            .groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect())
    found = {(r["part"], r["entry"], r["at"]): int(r["total"]) for r in rows}
    fresh = [book.copy() for book in books]
    for (p, e, i), value in found.items():
        if i:
            fresh[p][e, i - 1] = value // found[p, e, 0]
    return fresh


def fit(cells: DataFrame, name: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of integer vectors (``name``, cells) of one length."""
    start = np.array(first_vectors(cells, name, entries), np.int64)
    if not len(start):
        return []
    width = start.shape[1] // parts
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(parts)]
    stored = distinct_parts(cells, start.shape[1], parts)
    for _ in range(rounds):
        books = _round(stored, books)
    return books


def encode(cells: DataFrame, books: Books, *keep: str) -> DataFrame:
    """``keep``, code (two hex digits per part) and error of every row of ``cells``.

    A batch of rows is a trie of its own here, so no row is shuffled.
    """
    width = books[0].shape[1]
    dimensions = width * len(books)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(len(keep)), dimensions)
            codes, errors = np.zeros((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64)
            for p, book in enumerate(books):
                own = rows[:, p * width:(p + 1) * width]
                order, fresh = _distinct(own)
                code, error = nearest(np.ascontiguousarray(own[order[fresh]]), book)
                leaf = np.empty(len(rows), np.int64)
                leaf[order] = np.cumsum(fresh) - 1
                codes[:, p] = code[leaf]
                errors += error[leaf]
            text = codes.tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()),
                 pa.array(errors)], [*keep, "code", "error"])

    return cells.select(*keep, "cells").mapInArrow(run, f"{types}, code string, error long")


def spelled(books: Books) -> str:
    """All components by part, entry and position, in decimal."""
    return ",".join(str(v) for book in books for v in book.ravel().tolist())


def compress(vectors: DataFrame, name: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``name``, code, error, label_error, codebooks_sha256 of every kept row."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    cells = integer_vectors(vectors, vector, scale, name, label).filter(F.size("cells") % parts == 0)
    lead = cells.filter(F.col(name).isNotNull()).select(name, F.size("cells").alias("n")).orderBy(name, "n").first()
    empty = f"select cast(null as {dict(vectors.dtypes)[name]}) as `{name}`, '' as code, 0L as error, 0L as label_error, '' as codebooks_sha256"
    if lead is None:
        return vectors.sparkSession.sql(empty).filter("false")
    cells = cells.filter(F.size("cells") == lead["n"])
    books = fit(cells, name, parts, entries, rounds)
    coded = checkpoint(encode(cells, books, name, label))
    totals = few(coded.groupBy(label).agg(F.sum("error").alias("label_error")).withColumnRenamed(label, "_label"))
    return (coded.join(totals, F.col(label).eqNullSafe(F.col("_label")))
            .select(name, "code", "error", "label_error",
                    F.lit(hashlib.sha256(spelled(books).encode()).hexdigest()).alias("codebooks_sha256")))


def _oracle() -> str:
    """The rounds written out, one table per round."""
    steps = ["""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS c
        FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
             "parts AS MATERIALIZED (SELECT vec_id, p, c[p * (len(c) // 8) + 1 : (p + 1) * (len(c) // 8)] AS v FROM kept, range(8) t(p))",
             """b0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e
        FROM parts) WHERE e < 16)"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, x.p, x.v, min(16 * list_sum(list_transform(list_zip(x.v, y.v),
        lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + e)::BIGINT AS m FROM parts x JOIN b{k} y USING (p) GROUP BY vec_id, x.p, x.v)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS MATERIALIZED (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
        SELECT p, m % 16 AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(v)) FROM parts)) t(i)
        GROUP BY ALL) GROUP BY p, e)""")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(s.v, b.v) AS v FROM b{k} b LEFT JOIN s{k} s USING (p, e))")
    return "WITH " + ",\n".join(steps) + f""",
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, i, v[i] AS x FROM b{ROUNDS},
          range(1, 1 + (SELECT max(len(v)) FROM parts)) t(i))),
coded AS (SELECT vec_id, string_agg(printf('%02x', (m % 16)::INTEGER), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error
          FROM a{ROUNDS} GROUP BY vec_id),
labelled AS (SELECT * FROM coded JOIN kept USING (vec_id))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM labelled, books"""


@query(_oracle())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
