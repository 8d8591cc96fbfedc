"""Counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and their first four and five letters
(presence, not counts).  Every labelled text that names a group gets a twin in which
the identity terms are swapped for others of the same kind; the squared change of the
linear score between a text and its twin is added to the loss, so that the mere mention
of one group rather than another cannot carry the verdict.

Defined results: null and empty texts get the score of a text without known words;
rows are scored one by one, so repeated rows get equal scores and no row is lost; with
no labels, or labels of one class only, every text gets the smoothed share of that class.
Other columns of the input never matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fold, labelled_sample, sigmoid, table
from .registry import query

#: Terms that name a group, by kind; one term may replace another of its kind.
IDENTITY_TERMS: dict[str, list[str]] = {
    "religion": ["christian", "christians", "muslim", "muslims", "jewish", "jew", "jews", "hindu", "hindus",
                 "buddhist", "buddhists", "sikh", "sikhs", "atheist", "atheists", "catholic", "catholics"],
    "gender": ["man", "men", "woman", "women", "male", "female", "boy", "girl", "transgender", "nonbinary"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"],
    "origin": ["black", "white", "asian", "african", "european", "american", "mexican", "chinese", "indian",
               "arab", "latino", "hispanic", "german", "french", "spanish", "immigrant", "immigrants",
               "refugee", "refugees"],
    "age and health": ["old", "young", "elderly", "disabled", "blind", "deaf"],
}
SAMPLE = 12_000         # labelled texts used for fitting
VOCABULARY = 3_000      # features of the model
LEAST = 4               # labelled texts a feature must occur in
RIDGE = 1.0
SWAP = 100.0            # weight of the squared score change of a text and its twin
ROUNDS = 400
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[str, ...]:
    return (word,) if len(word) < 4 else (word, f"{word[:4]}^", f"{word[:5]}^")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def twin(words: set[str], kinds: dict[str, list[str]] = IDENTITY_TERMS) -> set[str]:
    """The words with every identity term swapped for another of its kind that the text lacks.

    A hash of the words picks which, so that over many texts each term meets all the others.
    """
    out, pick = set(words), None
    for terms in kinds.values():
        for term in terms:
            if term in words:
                others = [t for t in terms if t not in words]
                pick = zlib.crc32(" ".join(sorted(words)).encode()) if pick is None else pick + 1
                out.discard(term)
                out.update(others[pick % len(others):][:1] if others else [term])
    return out


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        known = self.weights
        if not known:
            return float(sigmoid(np.float64(self.intercept)))
        found = {f for w in words_of(text) for f in features_of(w) if f in known}
        # Summed in a fixed order, so that equal texts get equal doubles on every worker.
        return float(sigmoid(np.float64(self.intercept + sum(known[f] for f in sorted(found)))))


def _present(of: dict[str, int] | None, kinds: dict[str, list[str]]):
    """Arrow function: features per text (all as strings, or the known ones as ids with their twins)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            feats = [{f for w in ws for f in features_of(w)} for ws in words]
            if of is None:
                cols = {"feature": pa.array([list(f) for f in feats], pa.list_(pa.string()))}
            else:
                swapped = [{f for w in twin(ws, kinds) for f in features_of(w)} for ws in words]
                ids = lambda sets: pa.array([sorted(of[f] for f in s if f in of) for s in sets], pa.list_(pa.int32()))
                cols = {"ids": ids(feats), "twin": ids(swapped)}
            yield pa.RecordBatch.from_pydict(cols | {"y": batch.column(1)})
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None,
        sample: int = SAMPLE, vocabulary: int = VOCABULARY, swap: float = SWAP,
        kinds: dict[str, list[str]] = IDENTITY_TERMS) -> Model:
    """Learn from about ``sample`` labelled rows at most; ``keep`` says which labels may be used.

    The driver gets ``vocabulary`` features and, per labelled text, the ids of those it has.
    """
    rows = checkpoint(labelled_sample(docs, labels, label, sample, keep).select("text", "y"))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = (ones + 1.0) / (n + 2.0)
    if not 0 < ones < n:
        return Model(float(np.log(share / (1 - share))))
    counts = (rows.mapInArrow(_present(None, kinds), "feature array<string>, y int")
              .select(F.explode("feature").alias("feature"), "y")
              .groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
              .filter(F.col("a") + F.col("b") >= LEAST))
    contrast = F.abs(F.log((F.col("a") + 0.5) / (ones + 1.0)) - F.log((F.col("b") + 0.5) / (n - ones + 1.0)))
    top = (counts.orderBy((contrast * F.sqrt(F.col("a") + F.col("b"))).desc(), "feature")
           .limit(vocabulary).select("feature").collect())
    named = sorted({f for terms in kinds.values() for t in terms for f in features_of(t)})
    names = list(dict.fromkeys([r["feature"] for r in top] + named))
    found = rows.mapInArrow(_present({f: i for i, f in enumerate(names)}, kinds),
                            "ids array<int>, twin array<int>, y int").toArrow()
    y = found["y"].to_numpy().astype(float)
    order = np.lexsort((y, *zip(*[(len(i), sum(i)) for i in found["ids"].to_pylist()])))
    w, b = _descend(found["ids"].to_pylist(), found["twin"].to_pylist(), y, order, len(names), swap)
    return Model(b, {f: float(v) for f, v in zip(names, w) if abs(v) > 1e-6})


def _csr(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    return flat, np.repeat(np.arange(len(lists)), sizes)


def _descend(ids, twins, y, order, width: int, swap: float) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on log loss + ridge + swap penalty, steps from the curvature bound."""
    ids, twins, y = [ids[i] for i in order], [twins[i] for i in order], y[order]
    col, row = _csr(ids)
    pairs = [(sorted(set(t) - set(i)), sorted(set(i) - set(t))) for i, t in zip(ids, twins) if i != t]
    plus_col, plus_row = _csr([p for p, _ in pairs])
    less_col, less_row = _csr([q for _, q in pairs])
    n, m = len(y), max(1, len(pairs))
    # A step per feature: the diagonal bound of the Hessian by row sums of |X|'|X|.
    per_row = np.bincount(row, minlength=n) + 1.0
    bound = 0.25 * np.bincount(col, per_row[row], width) + RIDGE
    if pairs:
        per_pair = np.bincount(plus_row, minlength=m) + np.bincount(less_row, minlength=m)
        bound += swap * (np.bincount(plus_col, per_pair[plus_row], width)
                         + np.bincount(less_col, per_pair[less_row], width))
    bound_b = 0.25 * per_row.sum()
    w = v = np.zeros(width)
    b = u = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    for k in range(ROUNDS):
        r = sigmoid(np.bincount(row, v[col], n) + u) - y
        grad = np.bincount(col, r[row], width) + RIDGE * v
        if pairs:
            d = np.bincount(plus_row, v[plus_col], m) - np.bincount(less_row, v[less_col], m)
            grad += swap * (np.bincount(plus_col, d[plus_row], width) - np.bincount(less_col, d[less_row], width))
        w_next, b_next = v - grad / bound, u - r.sum() / bound_b
        pull = k / (k + 3)
        v, u = w_next + pull * (w_next - w), b_next + pull * (b_next - b)
        w, b = w_next, float(b_next)
    return w, b


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # VOCABULARY weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.score
        for batch in batches:
            scores = pa.array((of(t.as_py()) for t in batch.column(1)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    return (docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


HELD_OUT, FOLDS = 2, 4


@query()
def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), keep=fold("doc_id", FOLDS) != HELD_OUT)
    return score(docs, model).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
