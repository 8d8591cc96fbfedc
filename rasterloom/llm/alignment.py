"""Alignment of the tokens of two tokenizers by lockstep merging.

Tokens of A and B cover the same bytes; where both end, the text is cut into groups.  One
state vector holds the A pointer and the B pointer of many stretches of text at once: in every step
each stretch advances the pointer whose token ends first, or both where they end together,
which emits a group; stretches that are through are compacted out of the vector.

A stretch lies between two places where both tokenizers surely begin a new token: before a
space after another character, around a single line break, and before punctuation after a Latin
letter where no piece of B holds both.  Equal stretches of a worker's
texts are aligned once and remembered.  Stretches of more than LANE tokens are cut further
where probes find a common end, so that a few long ones do not go on alone.

A pair's count is the number of documents that hold it linked; it is summed per pair before any
shuffle.  The counts go back to the documents through a broadcast of the commonest pairs, at
most COMMON of them; rarer pairs, each in few documents, are joined by shuffle.  So no hot pair
ever is a shuffle key, and the table may grow with the corpus.

Defined results: texts that are null or empty, or whose tokens of either kind do not spell
space + text, have no tokens, groups or links; every row is a document, so repeated rows count
each; an empty table gives no rows.  Other columns never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, shared_folder, slices, table
from .pieces import NONE, SPACE, Vocabulary, vocabulary
from .registry import query
from .wordstore import LETTER_MARK_RE2, BytePairs, PieceStore, rows_of

LANE = 64                   # tokens of A from which a stretch is probed for common ends
CROSS = 2_000_000           # link pairs expanded at a time
WIDE = 4_096                # links of a group beyond which its distinct ids are paired at once
SLICE = 2_000_000           # bytes of text aligned at a time
KNOWN = 200_000             # distinct stretches that a worker remembers
AT_ONCE = 20_000            # new stretches aligned at a time
COMMON = 2_000_000          # pairs whose counts are broadcast


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, a_to: np.ndarray,
             b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups (a_start, a_stop, b_start, b_stop) of all lanes, in order.

    ``a_end`` and ``b_end`` are the byte ends of all tokens; a lane has the A tokens from
    ``a_from`` to ``a_to`` and the B tokens from ``b_from`` on, up to the same byte.
    """
    i, j, stop = a_from.copy(), b_from.copy(), a_to
    live = i < stop
    i, j, stop = i[live], j[live], stop[live]
    a_cut, b_cut = i.copy(), j.copy()
    found: list[tuple[np.ndarray, ...]] = []
    while len(i):
        a, b = a_end[i], b_end[j]
        i, j = i + (a <= b), j + (b <= a)
        cut = a == b
        if cut.any():
            found.append((a_cut[cut], i[cut], b_cut[cut], j[cut]))
            a_cut, b_cut = np.where(cut, i, a_cut), np.where(cut, j, b_cut)
            live = i < stop         # a lane ends with a cut
            if not live.all():
                i, j, a_cut, b_cut, stop = i[live], j[live], a_cut[live], b_cut[live], stop[live]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    starts, stops, b_starts, b_stops = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(starts)
    return starts[order], stops[order], b_starts[order], b_stops[order]


def lanes(a_end: np.ndarray, b_end: np.ndarray, a_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a_from, a_to, b_from of lanes: the stretches (``a_counts`` tokens of A each), long ones cut at probes."""
    stops = np.cumsum(a_counts)
    place = np.arange(len(a_end)) - np.repeat(stops - a_counts, a_counts)
    probe = np.flatnonzero(place % LANE == LANE - 1)
    near = np.minimum(np.searchsorted(b_end, a_end[probe]), max(len(b_end) - 1, 0))
    probe = probe[b_end[near] == a_end[probe]]
    end = np.zeros(len(a_end) + 1, bool)
    end[stops[a_counts > 0]] = end[probe + 1] = True
    a_to = np.flatnonzero(end)
    a_from = np.append(0, a_to[:-1])[:len(a_to)]
    b_to = np.searchsorted(b_end, a_end[a_to - 1]) + 1
    return a_from, a_to, np.append(0, b_to[:-1])[:len(b_to)]


class Aligner:
    """Both tokenizers, and what a worker has learnt about stretches of text."""

    def __init__(self, a_path: str, b_path: str):
        self.a = BytePairs(a_path, specials_are_text=True)
        self.b: Vocabulary = vocabulary(b_path)
        if not self.b.cut_at_space:
            raise ValueError("pieces of B go across spaces")
        # Whether B surely cuts around a line break, and before punctuation after a Latin letter.
        self.lines = bool(self.b.whole[10])
        texts = "\n".join(map(self.b.library.id_to_piece, np.flatnonzero(self.b.rank != NONE).tolist()))
        self.marks = not pc.match_substring_regex(pa.array([texts]), LETTER_MARK_RE2)[0].as_py()
        self.b_width = np.fromiter(map(len, self.b.raw), np.int64, len(self.b.raw))
        self.base = len(self.b.raw)             # a pair is one number: id of A * base + id of B
        self.shown = [f"{i}{c}".encode() for i in range(len(self.a.raw)) for c in ",|"]
        self.shown += [f"{i}{c}".encode() for i in range(self.base) for c in ",;"]
        self.size = np.fromiter(map(len, self.shown), np.int64, len(self.shown))
        small = np.int32 if len(self.a.raw) * self.base < 1 << 31 else np.int64
        # links (pair, number) | n_a, n_b, n_groups, n_links, whether both spell the stretch | groups as text
        self.store = PieceStore(self._learn, [small, np.int64, np.int64, object], KNOWN)

    def _b_ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = "".join(stretches).replace(" ", chr(SPACE))
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(stretches), np.int64)
        stops = np.cumsum(sizes)
        starts = self.b._word_starts(points, stops - sizes, sizes)
        ids, counts = self.b._encode_words(points, starts, np.diff(np.append(starts, len(points))))
        until = np.append(0, np.cumsum(counts))[np.searchsorted(starts, stops)]
        return ids, np.diff(np.append(0, until))

    def _learn(self, stretches: list[str]) -> list[tuple[Any, Any]]:
        parts = [self._lockstep(stretches[i:i + AT_ONCE]) for i in range(0, len(stretches), AT_ONCE)]
        columns = [list(zip(*column)) for column in zip(*parts)]
        return [*((np.concatenate(values), np.concatenate(counts)) for values, counts in columns[:-1]),
                (list(chain.from_iterable(columns[-1][0])), None)]

    def _lockstep(self, stretches: list[str]) -> list[tuple[Any, Any]]:
        a_ids, a_counts = self.a.encode(stretches)
        b_ids, b_counts = self._b_ids(stretches)
        good = (self._spells(stretches, a_ids, a_counts, self.a.raw, self.a.width)
                & self._spells(stretches, b_ids, b_counts, self.b.raw, self.b_width))
        if not good.all():
            a_ids, b_ids = a_ids[np.repeat(good, a_counts)], b_ids[np.repeat(good, b_counts)]
            a_counts, b_counts = np.where(good, a_counts, 0), np.where(good, b_counts, 0)
        a_end, b_end = np.cumsum(self.a.width[a_ids]), np.cumsum(self.b_width[b_ids])
        a0, a1, b0, b1 = lockstep(a_end, b_end, *lanes(a_end, b_end, a_counts))
        m, n = a1 - a0, b1 - b0
        of = np.searchsorted(np.cumsum(a_counts), a0, "right")      # the stretch of each group
        many = len(stretches)
        n_links = np.zeros(many, np.int64)
        np.add.at(n_links, of, m * n)
        facts = np.column_stack([a_counts, b_counts, np.bincount(of, minlength=many), n_links, good]).astype(np.int64)
        # Tokens in the order of their groups, those of A first, each with the sign that follows it.
        at_a, at_b = np.arange(len(a_ids)) + np.repeat(b0, m), np.arange(len(b_ids)) + np.repeat(a1, n)
        signs = np.zeros(len(a_ids) + len(b_ids), np.int64)
        signs[at_a] = 2 * a_ids.astype(np.int64)
        signs[at_b] = 2 * (len(self.a.raw) + b_ids.astype(np.int64))
        signs[a1 + b0 - 1] += 1
        signs[a1 + b1 - 1] += 1
        joined = b"".join(map(self.shown.__getitem__, signs.tolist()))
        ends = np.append(0, np.cumsum(self.size[signs]))[np.cumsum(a_counts + b_counts)].tolist()
        shown = [joined[x:y] for x, y in zip([0, *ends[:-1]], ends)]
        pairs, times, per = self._links(a_ids.astype(np.int64), b_ids.astype(np.int64), a0, b0, m, n, of, many)
        return [(pairs, per), (times, per), (facts.ravel(), np.full(many, facts.shape[1])), (shown, None)]

    @staticmethod
    def _spells(stretches: list[str], ids: np.ndarray, counts: np.ndarray, raw: list[bytes],
                width: np.ndarray) -> np.ndarray:
        """Whether the joined tokens of each stretch are its bytes."""
        spelt = b"".join(map(raw.__getitem__, ids.tolist()))
        if spelt == "".join(stretches).encode():
            ends = np.append(0, np.cumsum(width[ids]))[np.cumsum(counts)]
            sizes = np.cumsum(pc.binary_length(pa.array(stretches, pa.string())).to_numpy())
            if (ends == sizes).all():
                return np.ones(len(stretches), bool)
        stops = np.cumsum(counts).tolist()
        listed = ids.tolist()
        return np.fromiter((b"".join(map(raw.__getitem__, listed[y - c:y])) == s.encode()
                            for s, c, y in zip(stretches, counts.tolist(), stops)), bool, len(stretches))

    def _links(self, a_ids, b_ids, a0, b0, m, n, of, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each stretch, how often it links each, and their number per stretch."""
        span = len(self.a.raw) * self.base
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cross = m * n
        for g in np.flatnonzero(cross > WIDE).tolist():
            left, lc = np.unique(a_ids[a0[g]:a0[g] + m[g]], return_counts=True)
            right, rc = np.unique(b_ids[b0[g]:b0[g] + n[g]], return_counts=True)
            keys.append((of[g] * span + left[:, None] * self.base + right[None]).ravel())
            times.append((lc[:, None] * rc[None]).ravel())
        small = np.flatnonzero(cross <= WIDE)
        total = np.cumsum(cross[small])
        low = 0
        while low < len(small):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + CROSS, "right")))
            g = small[low:high]
            size = cross[g]
            group = np.repeat(g, size)
            within = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
            key, count = np.unique(of[group] * span + a_ids[a0[group] + within // n[group]] * self.base
                                   + b_ids[b0[group] + within % n[group]], return_counts=True)
            keys.append(key)
            times.append(count)
            low = high
        key, number = _summed(np.concatenate(keys), np.concatenate(times))
        return key % span, number, np.bincount(key // span, minlength=many)

    def align(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Columns of the texts' alignments."""
        texts = texts.fill_null("")
        led = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise("", texts, " "))
        rows, counts = rows_of(self.store, led, lines=self.lines, marks=self.marks)
        pairs, times, facts, shown = self.store.columns
        many = len(texts)
        stops = np.cumsum(counts)
        doc = np.repeat(np.arange(many), counts)
        each = facts.take(rows)[0].reshape(-1, 5)
        sums = np.diff(np.vstack([np.zeros((1, 5), np.int64), np.cumsum(each, axis=0)])[np.append(0, stops)], axis=0)
        good = (sums[:, 4] == counts) & (pc.binary_length(texts).to_numpy() > 0)
        sums[~good] = 0
        parts = shown.take(rows)
        digest = [hashlib.sha256(b"".join(parts[x:y])[:-1]).hexdigest() if ok else ""
                  for x, y, ok in zip((stops - counts).tolist(), stops.tolist(), good.tolist())]
        rows, doc = rows[good[doc]], doc[good[doc]]
        pair, per = pairs.take(rows)
        time, _ = times.take(rows)
        span = len(self.a.raw) * self.base
        key, number = _summed(np.repeat(doc, per) * span + pair, time)
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(key // span, minlength=many))).astype(np.int32))
        return {"n_a": pa.array(sums[:, 0]), "n_b": pa.array(sums[:, 1]), "n_groups": pa.array(sums[:, 2]),
                "n_links": pa.array(sums[:, 3]), "groups_sha256": pa.array(digest, pa.string()),
                "pairs": pa.ListArray.from_arrays(offsets, pa.array(key % span)),
                "times": pa.ListArray.from_arrays(offsets, pa.array(number))}

    def groups(self, text: str | None) -> list[tuple[list[int], list[int]]]:
        """The groups of one text as lists of ids."""
        led = pa.array([" " + text if text else ""])
        rows, _ = rows_of(self.store, led, lines=self.lines, marks=self.marks)
        if not text or not self.store.columns[2].take(rows)[0].reshape(-1, 5)[:, 4].all():
            return []
        listed = b"".join(self.store.columns[3].take(rows))[:-1].decode()
        return [tuple([int(i) for i in side.split(",")] for side in group.split("|")) for group in listed.split(";")]


def _summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sum of their numbers."""
    if len(numbers) == 0 or numbers.max() == 1:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[heads], np.add.reduceat(numbers, heads)


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of two files, kept by each worker process."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """key, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every row, stored in the shared folder.

    ``pairs`` are the distinct linked pairs of ids (one number each, see ``pair_ids``), ``times``
    how often the document links each of them.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        key, of = TaskContext.get().partitionId() << 40, aligner(a_path, b_path)
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE):
                found = of.align(batch.column(1).slice(low, high - low))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(high - low)), batch.column(0).slice(low, high - low), *(found[n] for n in names)],
                    ["key", "doc_id", *names])
                key += high - low

    path = shared_folder(docs.sparkSession, "aligned")
    docs.select("doc_id", "text").mapInArrow(
        run, f"key long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "pairs array<long>, times array<long>").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(made: DataFrame, base: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether n is the highest of the pair's A id), checkpointed."""
    counts = checkpoint(made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
                        .withColumn("a", F.floor(F.col("pair") / base)))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return checkpoint(counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def pair_ids(pair, base: int):
    """(id of A, id of B) of a pair column."""
    return F.floor(pair / base), pair % base


def scored(made: DataFrame, base: int, common: int = COMMON) -> DataFrame:
    """``made`` without its pairs, with n_best and count_sum."""
    counts = pair_counts(made, base)
    # The lowest count from which no more than ``common`` pairs are left; one row per distinct count.
    least = 1
    if counts.count() > common:
        at = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
        least = _least(at, common)
    linked = made.select("key", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    own = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
           F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = linked.join(F.broadcast(counts.filter(F.col("n") >= least)), "pair").groupBy("key").agg(*own)
    if least > 1:       # pairs of fewer documents than that: no hot keys among them
        rare = linked.join(counts.filter(F.col("n") < least), "pair").groupBy("key").agg(*own)
        sums = sums.unionByName(rare).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return made.drop("pairs", "times").join(sums, "key", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})


def _least(at: DataFrame, common: int) -> int:
    """The lowest count n whose pairs of n or more documents are at most ``common``, by bisection."""
    low, high = 1, at.agg(F.max("n")).first()[0] + 1
    while low < high:
        middle = (low + high) // 2
        if (at.filter(F.col("n") >= middle).agg(F.sum("m")).first()[0] or 0) <= common:
            high = middle
        else:
            low = middle + 1
    return low


def links(docs: DataFrame, a_path: str, b_path: str, common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    return scored(aligned(docs, a_path, b_path), len(vocabulary(b_path).raw), common).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query()
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))
