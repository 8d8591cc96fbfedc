"""Quality classifier by compression: how much better do good texts' phrases compress a text?

Two zstandard dictionaries of equal size are trained on equally many segments of good and
of bad labelled texts.  All segments of all training texts take part; where a class has
more of them than the other, or than TRAIN_BYTES hold, a hash of doc_id and place chooses.
A text is compressed with each, all of it, in segments short enough
that the dictionary and not the text's own history decides.  The difference of the two
sizes, normalised by length and by the square root of length, becomes a probability
through a logistic curve fitted on labelled texts that trained neither dictionary.

Defined results: null and empty texts get the curve's value at difference 0; rows
are scored one by one, so repeated rows get equal scores and no row is lost; with
no labels, or labels of one class only, every text gets the smoothed share of that
class.  Other columns of the input never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fit_logistic, fold, labelled_sample, sigmoid, slices, table
from .registry import query

SAMPLE = 12_000         # labelled texts used for fitting
DICTIONARY = 112_640    # bytes of each dictionary
SEGMENT = 512           # bytes compressed at a time
TRAIN_BYTES = 100 * DICTIONARY      # of segments that one dictionary learns from (zstandard's advice)
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]      # by the length, by its root, intercept
    level: int = LEVEL

    def scorer(self):
        """Function from a text to its score."""
        w = np.array(self.weights)
        if not self.good or not self.bad:
            return lambda text: float(sigmoid(w[-1]))
        features = _features(self.good, self.bad, self.level)
        return lambda text: float(sigmoid(np.append(features((text or "").encode()), 1.0) @ w))


def _features(good: bytes, bad: bytes, level: int):
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        trained = zstandard.ZstdCompressionDict(content)
        trained.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=False,
                                        write_dict_id=False)

    by_good, by_bad = compressor(good), compressor(bad)

    def of(raw: bytes) -> np.ndarray:
        saved = 0
        for at in range(0, len(raw), SEGMENT):
            part = raw[at:at + SEGMENT]
            saved += len(by_bad.compress(part)) - len(by_good.compress(part))
        return np.clip([10 * saved / (len(raw) + 1), saved / (len(raw) + 1) ** 0.5], -4, 4)

    return of


def _segments(texts: list[tuple[object, bytes]]) -> list[bytes]:
    """All segments of (doc_id, text) pairs, in the order of a hash of doc_id and place."""
    found = [(hashlib.blake2b(f"{key} {at}".encode(), digest_size=8).digest(), raw[at:at + SEGMENT])
             for key, raw in texts for at in range(0, len(raw), SEGMENT)]
    return [part for _, part in sorted(found)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:].ljust(8, b" ")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None,
        sample: int = SAMPLE, size: int = DICTIONARY, level: int = LEVEL) -> Model:
    """Learn from about ``sample`` labelled rows at most; ``keep`` says which labels may be used."""
    rows = labelled_sample(docs, labels, label, sample, keep).orderBy("doc_id", F.xxhash64("text"))
    known = [(r["doc_id"], r["text"].encode(), int(r["y"])) for r in rows.toLocalIterator()]
    train, rest = known[0::3] + known[1::3], known[2::3]
    sides = [[(key, t) for key, t, y in train if y == side] for side in (1, 0)]
    if not all(sides):
        w = fit_logistic(np.zeros((len(known), 2)), np.array([y for *_, y in known], float))
        return Model(b"", b"", tuple(w), level)
    samples = [_segments(s) for s in sides]
    most = min(*map(len, samples), TRAIN_BYTES // SEGMENT)
    good, bad = (_dictionary(s[:most], size) for s in samples)
    features = _features(good, bad, level)
    rest = rest or train
    w = fit_logistic(np.array([features(t) for _, t, _ in rest]), np.array([y for *_, y in rest], float))
    return Model(good, bad, tuple(w), level)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The rows of ``docs`` with the column ``name``: probability that a text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # two dictionaries of fixed size
    out_type = docs.drop(name).select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            for start, stop in slices(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(start, stop - start)
                texts = part.column(part.schema.get_field_index(text))
                scores = pa.array((of(t.as_py()) for t in texts), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, name])

    return docs.drop(name).mapInArrow(run, out_type)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted per row."""
    return (score(docs.select("doc_id", "text"), model)
            .select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


HELD_OUT, FOLDS = 0, 5


@query()
def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), keep=fold("doc_id", FOLDS) != HELD_OUT)
    return classify(docs, model).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
