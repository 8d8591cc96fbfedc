"""Token ids in a Parquet file format with selective reads.

One row per document, in ascending doc_id order over the whole folder: an int list with
the ids, the offset of its first id within the part, the number of ids and the part's
number.  Writer settings: page version 2 (delta-packed integers, prefix-coded strings),
dictionary pages for the id list alone, row groups and pages of bounded bytes, page
indexes.  Readers prune by doc_id and read metadata without touching the ids.

Defined results: null and empty texts have only the end id; rows with equal or null
doc_id are kept, nulls first, ties ordered by a hash of the text, so repeated rows follow
each other; an empty table gives an empty folder that reads back as no rows.  Other
columns of the input never matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder, slices, table
from .registry import query
from .wordstore import BytePairs, PieceStore, rows_of

END_ID = 2
ROW_GROUP = 16 << 20        # bytes of a row group
PAGE = 256 << 10            # bytes of a page: the least that a selective read touches
SLICE = 4_000_000           # bytes of text encoded at a time
KNOWN = 600_000             # distinct pieces of text that a worker remembers

WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.page.write-checksum.enabled": "true",
    "compression": "zstd",
}
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
    T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

class Encoder:
    """Ids of whole texts; what repeats is encoded once and remembered in flat arrays."""

    def __init__(self, path: str, most: int = KNOWN):
        self.pairs = BytePairs(path)
        self.store = PieceStore(lambda pieces: [self.pairs.encode(pieces)], [np.int32], most)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end ids included, and the number of ids per text; null texts are empty.

        Texts that name a special token of the file are cut at sure spaces only, and the library
        finds it.
        """
        rows, counts = rows_of(self.store, texts, marks=True, whole=self.pairs.specials)
        ids, each = self.store.columns[0].take(rows)
        stops = np.append(0, np.cumsum(each))[np.cumsum(counts)]
        return np.insert(ids, stops, END_ID), np.diff(np.append(0, stops)) + 1


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of SCHEMA in ascending doc_id order, one part per partition.

    Texts are dealt out by range of doc_id before they are encoded, so that each is
    encoded once; sampling for the ranges reads the documents but runs no tokenizer.
    """
    placed = (docs.select("doc_id", "text")
              .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, start = TaskContext.get().partitionId(), 0
        of = encoder(tokenizer)
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE):
                flat, n = of.encode(batch.column(1).slice(low, high - low))
                stops = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.full(len(n), part, np.int32)),
                     pa.array(start + stops - n), pa.array(n), ids], SCHEMA.names)
                start += int(n.sum())

    return placed.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, tokenizer: str, path: str) -> str:
    """Encode and store all documents below ``path``."""
    tokenize(docs, tokenizer).write.options(**WRITER).parquet(path)
    return path


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids"),
         first: Any = None, last: Any = None) -> DataFrame:
    """Chosen columns of the documents with first <= doc_id <= last, each end optional.

    ``start`` is the number of ids of all documents before; it takes one row per part.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    wanted = stored
    if first is not None:
        wanted = wanted.filter(F.col("doc_id") >= first)
    if last is not None:
        wanted = wanted.filter(F.col("doc_id") <= last)
    if "start" in columns:
        sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
        total, before = 0, []
        for r in sizes:
            before.append((r["part"], total))
            total += r["n"]
        offsets = spark.createDataFrame(before, "part int, before long")
        wanted = (wanted.join(F.broadcast(offsets), "part")     # one row per part
                  .withColumn("start", F.col("before") + F.col("local_start")))
    return wanted.select(*columns)


def with_crc(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by the unsigned crc32 of their little-endian 32-bit values."""
    kept = [c for c in tokens.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            raw = memoryview(pc.list_flatten(lists).cast(pa.int32()).to_numpy().astype("<i4", copy=False)).cast("B")
            stops = 4 * np.cumsum(pc.list_value_length(lists).to_numpy())
            sums = [zlib.crc32(raw[a:b]) for a, b in zip([0, *stops[:-1]], stops)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())],
                                             [*kept, "ids_crc32"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name in kept)
    return tokens.select(*kept, "ids").mapInArrow(run, f"{types}, ids_crc32 long")


@query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 shared_folder(spark, "tokens"))
    return with_crc(read(spark, path))
