"""Best-fit packing of documents into sequences of a token limit, in bulk-synchronous steps.

A document is its token ids and an end id; one that is longer than the limit is cut into
pieces of the limit.  A piece of more than half the limit shares its sequence with no other
such piece, so it opens one.  The smaller ones follow in classes of falling size, a step each:

1. the documents of the class and the gaps of all sequences that hold the smallest of them are
   sorted by size in one range shuffle;
2. both are dealt out in that order, so that every task gets an even share of either, however
   many documents have one and the same length;
3. a task sweeps its documents from the largest down: each takes its successor, the smallest gap
   that holds it; of documents that want the same gap the first in rank gets it, the next
   goes on to the next larger one; a gap that took a document is the rest of it from
   then on; a document without successor opens a sequence;
4. the gaps, as they are now, go to the next step with the next class.

At the end the sequences that are not more than half full, one or two for each task of a step,
are opened again and their pieces swept once more, until one task has seen them all.  No table
of documents is sorted or held by one task or the driver; a task holds STRIPE rows.

Defined results: null and empty texts are the end id alone; repeated rows and rows with equal or
null doc_id are packed each on its own; an empty table gives no rows; very long texts are cut
as above.  Equal sizes rank by the key of the piece.  Other columns never matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import few
from .common import checkpoint, shared_folder, slices, table
from .registry import query
from .wordstore import LETTER_MARK_RE2, LOWER_WORD, BytePairs, PieceStore

LIMIT, END_ID = 4096, 1
STRIPE = 100_000            # documents and gaps that one task sweeps
SLICE = 4_000_000           # bytes of text encoded at a time
KNOWN = 600_000             # distinct pieces of text that a worker remembers


# -- token ids --------------------------------------------------------------------------

class Encoder:
    """Ids of whole texts by a tokenizer that drops white space and lower-cases.

    No token of such a tokenizer goes across white space, so a text is the sum of its words.
    """

    def __init__(self, path: str):
        self.pairs = BytePairs(path)
        self.store = PieceStore(lambda words: [self.pairs.encode(words, LOWER_WORD)], [np.int32], KNOWN)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of ids per text; null texts are empty."""
        texts = texts.fill_null("")
        lower = pc.ascii_lower(texts)
        odd = reduce(pc.or_, (pc.match_substring(lower, s.lower()) for s in self.pairs.specials),
                     pa.array(np.zeros(len(texts), bool)))
        plain = pc.if_else(odd, "", lower)
        for blank in "\n\t\r":
            plain = pc.replace_substring(plain, blank, " ")
        plain = pc.replace_substring_regex(plain, LETTER_MARK_RE2, r"\1 \2")    # a new word of the rules, too
        words = pc.split_pattern(plain, " ")
        coded = pc.list_flatten(words).dictionary_encode()
        rows = self.store.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        ids, per_word = self.store.columns[0].take(rows)
        stops = np.append(0, np.cumsum(per_word))[np.cumsum(pc.list_value_length(words).to_numpy())]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))[::-1].tolist():     # the names of special tokens
            extra = np.array(self.pairs.one(texts[i].as_py()), np.int32)
            ids = np.insert(ids, stops[i], extra)
            stops[i:] += len(extra)
        return ids, np.diff(np.append(0, stops))


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """key, doc_id, piece, start, length, ids_crc32[, ids] of every piece, stored in the shared folder.

    ``key`` numbers the pieces of the table.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["key", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        key, of = TaskContext.get().partitionId() << 40, encoder(tokenizer)
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE):
                ids, n = of.encode(batch.column(1).slice(low, high - low))
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<i4")
                n = n + 1
                many = -(-n // limit)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                length = np.minimum(limit, n[doc] - piece * limit)
                stops = np.cumsum(length)
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((stops - length).tolist(), stops.tolist())]
                out = [pa.array(key + np.arange(len(doc))), batch.column(0).slice(low, high - low).take(pa.array(doc)),
                       pa.array(piece.astype(np.int32)), pa.array(piece * limit), pa.array(length), pa.array(sums, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(ids)))
                key += len(doc)
                yield pa.RecordBatch.from_arrays(out, names)

    path = shared_folder(docs.sparkSession, "pieces")
    schema = f"key long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs.select("doc_id", "text").mapInArrow(run, schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


# -- sweeps -----------------------------------------------------------------------------

def sweep(docs: list[tuple[int, int]], gaps: list[tuple[int, int]], limit: int) -> tuple[list, list]:
    """Best fit of documents (size, key), largest first, into gaps (size, sequence).

    Returns (key, sequence, offset) per document and the (sequence, size) of the gaps left.
    """
    held: dict[int, list[int]] = {}
    open_ = 0                   # bit g: there is a gap of size g
    for size, sequence in sorted(gaps, reverse=True):       # the smallest sequence number is taken first
        held.setdefault(size, []).append(sequence)
        open_ |= 1 << size
    placed = []
    for size, key in sorted(docs, key=lambda d: (-d[0], d[1])):
        larger = open_ >> size
        if larger:
            gap = size + (larger & -larger).bit_length() - 1
            sequence = held[gap].pop()
            if not held[gap]:
                open_ ^= 1 << gap
        else:
            gap, sequence = limit, key
        placed.append((key, sequence, limit - gap))
        rest = gap - size
        if rest:
            held.setdefault(rest, []).append(sequence)
            open_ |= 1 << rest
    return placed, [(sequence, size) for size, those in held.items() for sequence in those]


_STEP = "is_gap boolean, id long, sequence long, at int"


def _step(docs: DataFrame, gaps: DataFrame | None, limit: int, tasks: int) -> DataFrame:
    """Rows of _STEP after a sweep: (document, sequence, offset), and (sequence, sequence, gap)."""
    rows = docs.select(F.lit(False).alias("is_gap"), F.col("key").alias("id"), F.col("length").cast("int").alias("size"))
    if gaps is not None:
        rows = rows.unionByName(gaps.select(F.lit(True).alias("is_gap"), F.col("sequence").alias("id"),
                                            F.col("gap").cast("int").alias("size")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        turn = [TaskContext.get().partitionId()] * 2        # of documents and of gaps
        for batch in batches:
            is_gap = batch.column(0).to_numpy(zero_copy_only=False)
            stripe = np.zeros(len(is_gap), np.int32)
            for kind in (0, 1):
                own = np.flatnonzero(is_gap == bool(kind))
                stripe[own] = (turn[kind] + np.arange(len(own))) % tasks
                turn[kind] += len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stripe)], ["is_gap", "id", "size", "stripe"])

    def run(group: pa.Table) -> pa.Table:
        is_gap = group.column("is_gap").to_numpy()
        ids, sizes = group.column("id").to_numpy(), group.column("size").to_numpy()
        both = [list(zip(sizes[at].tolist(), ids[at].tolist())) for at in (~is_gap, is_gap)]
        placed, left = sweep(*both, limit)
        found = np.array(placed + [(s, s, g) for s, g in left], np.int64).reshape(-1, 3)
        return pa.table({"is_gap": pa.array(np.arange(len(found)) >= len(placed)), "id": pa.array(found[:, 0]),
                         "sequence": pa.array(found[:, 1]), "at": pa.array(found[:, 2].astype(np.int32))})

    order = [F.col("size").desc(), F.col("is_gap").desc(), F.col("id").asc()]
    dealt = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
             .mapInArrow(deal, "is_gap boolean, id long, size int, stripe int"))
    return checkpoint(dealt.groupBy("stripe").applyInArrow(run, _STEP))


def pack(sizes: DataFrame, limit: int = LIMIT, stripe: int = STRIPE) -> DataFrame:
    """key, sequence_id, offset of every row of ``sizes`` (unique key, length from 1 to ``limit``).

    ``sequence_id`` is the key of the sequence's first piece.
    """
    sizes = sizes.select("key", "length")
    cuts = [limit // 2]
    while cuts[-1] > 1:
        cuts.append(cuts[-1] // 4)
    cuts = [c for c in cuts if c] + [0]
    counted = sizes.agg(*(F.count(F.when((F.col("length") > lo) & (F.col("length") <= hi), 1)).alias(str(lo))
                          for hi, lo in zip(cuts, cuts[1:]))).first()
    big = sizes.filter(F.col("length") > cuts[0])
    placed = [big.select("key", F.col("key").alias("sequence_id"), F.lit(0).alias("offset"))]
    gaps = big.select(F.col("key").alias("sequence"), (F.lit(limit) - F.col("length")).cast("int").alias("gap")).filter("gap > 0")
    split = False
    for hi, lo in zip(cuts, cuts[1:]):
        if not counted[str(lo)]:
            continue
        fits = gaps.filter(F.col("gap") > lo)
        tasks = -(-(counted[str(lo)] + fits.count()) // stripe)
        split |= tasks > 1
        done = _step(sizes.filter((F.col("length") > lo) & (F.col("length") <= hi)), fits, limit, tasks)
        placed.append(_placed(done))
        gaps = gaps.filter(F.col("gap") <= lo).unionByName(_gaps(done))
    found = reduce(DataFrame.unionByName, placed)
    while split:
        # Not more than half full: two of them would fit into one, but they met in no task.
        loose = checkpoint(gaps.filter(F.col("gap") * 2 >= limit).select(F.col("sequence").alias("sequence_id")))
        before = loose.count()
        if before < 2:
            break
        again = found.join(few(loose), "sequence_id", "left_semi").select("key")
        again = checkpoint(again.join(sizes, "key"))
        tasks = -(-again.count() // stripe)
        done = _step(again, None, limit, tasks)
        found = found.join(few(loose), "sequence_id", "left_anti").select("key", "sequence_id", "offset").unionByName(_placed(done))
        gaps = _gaps(done)
        split = tasks > 1 and gaps.filter(F.col("gap") * 2 >= limit).count() < before
    return found


def _placed(done: DataFrame) -> DataFrame:
    return done.filter("not is_gap").select(F.col("id").alias("key"), F.col("sequence").alias("sequence_id"), F.col("at").alias("offset"))


def _gaps(done: DataFrame) -> DataFrame:
    return done.filter("is_gap").select("sequence", F.col("at").alias("gap"))


def packed(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids] of every piece."""
    made = pieces(docs, tokenizer, limit, end_id, with_ids)
    return (made.join(pack(made, limit), "key")
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"),
                    *(["ids"] if with_ids else [])))


def sequences(packing: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids of every packed sequence of ``packed`` with ids; a sequence is bounded by the limit."""
    return (packing.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("by"))
            .select("sequence_id", F.flatten("by.ids").alias("ids"), F.col("by.doc_id").alias("doc_ids")))


@query()
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumn(
        "length", F.col("length").cast("long"))
