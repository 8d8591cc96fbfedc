"""URL filter: rules by host and path, and for the rest a ratio of character language models.

One variable-order Markov model is counted over all accepted URLs and one over all rejected
ones; both are smoothed by Witten-Bell interpolation from the empty context up to ORDER
characters.  The difference of the two log-likelihoods per character, calibrated on URLs that
neither model has counted, decides.

URLs are folded to an alphabet of fixed size for the models, so the counts that are collected
and broadcast are bounded by the alphabet and ORDER, not by the input.

Defined results: null URLs and those without "://" have an empty host and path and fit no
rule; the models still judge their text; an empty text scores the calibration's intercept;
with no accepted or no rejected URL the rest is allowed.  Rows are judged one by one, so
repeated rows get equal verdicts and no row is lost; equal URLs fall on one side of the
calibration split.  Other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fit_logistic, sigmoid, table
from .registry import query

#: The rules of the registered query, (host and path, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]

#: The models' alphabet: letters, one sign for digits, the signs below, one for all else, and the start.
SIGNS = "./-_?=&#:%~+,;@!"
OTHER, START = "*", "^"
ALPHABET = START + "abcdefghijklmnopqrstuvwxyz" + "0" + SIGNS + OTHER
ORDER = 3
FOLDS = 5               # one of so many URLs calibrates
BINS, WIDTH = 2_000, 8.0    # histogram of score differences for the calibration


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, ruling: the longest rule that fits, else null."""
    host, path = parts(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):        # later and longer ones win
        site, slash, start = text.partition("/")
        # With a dot in front, the host itself and its subdomains end alike; an empty host fits nothing.
        fits = F.concat(F.lit("."), F.col("host")).endswith("." + site) & F.col("path").startswith(slash + start)
        rule, ruling = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return out.withColumn("rule", rule).withColumn("ruling", ruling)


def folded(url: Column) -> Column:
    """Lower-case text in the models' alphabet, ORDER starts in front."""
    low = F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    keep = "a-z0" + "".join("\\" + c for c in SIGNS)
    return F.concat(F.lit(START * ORDER), F.regexp_replace(low, f"[^{keep}]", OTHER))


def counts(labelled: DataFrame) -> DataFrame:
    """rejected (boolean), gram (context and next character), n over all labelled URLs (url, rejected).

    Equal URLs are counted together first, so that one URL may fill a third of the table.
    """
    urls = labelled.groupBy("url", "rejected").agg(F.count(F.lit(1)).alias("m"))
    text = folded(F.col("url"))
    grams = F.transform(F.sequence(F.lit(1), F.length("t") - ORDER), lambda i: F.substring("t", i, F.lit(ORDER + 1)))
    return (urls.withColumn("t", text).filter(F.length("t") > ORDER)
            .select("rejected", "m", F.explode(grams).alias("gram"))
            .groupBy("rejected", "gram").agg(F.sum("m").alias("n")))


def code(text: str) -> list[int]:
    return [ALPHABET.index(c) for c in text]


def log_probabilities(grams: dict[str, int]) -> np.ndarray:
    """log P(next | last ORDER characters) for every context, by Witten-Bell interpolation."""
    size = len(ALPHABET)
    full = np.zeros((size,) * (ORDER + 1), np.float64)
    for gram, n in grams.items():
        full[tuple(code(gram))] += n
    below = np.full(size, 1.0 / size)
    for order in range(ORDER + 1):
        seen = full.sum(axis=tuple(range(ORDER - order)))       # the last ``order`` characters and the next
        total, kinds = seen.sum(axis=-1, keepdims=True), (seen > 0).sum(axis=-1, keepdims=True)
        weight = np.where(total > 0, total / np.maximum(total + kinds, 1), 0.0)
        below = weight * seen / np.maximum(total, 1) + (1 - weight) * below
    return np.log(below).astype(np.float32)


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray | None        # log P accepted - log P rejected per context and next character
    slope: float = 0.0
    intercept: float = 0.0


def difference(texts: list[str], ratio: np.ndarray) -> np.ndarray:
    """Log-likelihood difference per character of folded texts; 0 for empty ones."""
    lookup = np.zeros(128, np.int64)
    lookup[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
    flat = lookup[np.frombuffer("".join(texts).encode("ascii"), np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    index = flat.copy()
    for k in range(1, ORDER + 1):
        index[k:] += flat[:-k] * len(ALPHABET) ** k
    value = np.append(0.0, np.cumsum(ratio.ravel()[index].astype(np.float64)))
    stops = np.cumsum(sizes)
    return (value[stops] - value[stops - sizes + ORDER]) / np.maximum(sizes - ORDER, 1)


def score(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` with score: probability that the URL is accepted."""
    if model.ratio is None:
        return urls.withColumn("score", F.lit(float(sigmoid(np.float64(model.intercept)))))
    shared = urls.sparkSession.sparkContext.broadcast(model)    # len(ALPHABET) ** (ORDER + 1) floats
    text = urls.withColumn("_text", folded(F.col("url")))
    schema = urls.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if batch.num_rows:
                d = difference(batch.column(batch.num_columns - 1).to_pylist(), known.ratio)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(sigmoid(known.slope * d + known.intercept))], schema.names)

    return text.mapInArrow(run, schema)


def fit(labelled: DataFrame) -> Model:
    """Models of all URLs of the counting folds, calibrated on all of the other one.

    ``labelled``: url, rejected (boolean).  The driver gets the bounded counts and a histogram.
    """
    side = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    rows = counts(labelled.filter(side > 0)).collect()      # at most 2 * len(ALPHABET) ** (ORDER + 1)
    grams = [{r["gram"]: r["n"] for r in rows if r["rejected"] == rejected} for rejected in (False, True)]
    if not all(grams):
        # Nothing to tell apart: the rest is allowed.
        return Model(None, 0.0, 1.0)
    ratio = log_probabilities(grams[0]) - log_probabilities(grams[1])
    held = score(labelled.filter(side == 0).select("url", "rejected"), Model(ratio, 1.0, 0.0))
    logit = F.log(F.col("score") / (1 - F.col("score")))
    cells = held.groupBy(F.floor(F.least(F.greatest(logit, F.lit(-WIDTH)), F.lit(WIDTH)) * (BINS / (2 * WIDTH)))
                         .alias("bin"), "rejected").agg(F.count(F.lit(1)).alias("n")).collect()     # 2 BINS cells
    x = np.array([(r["bin"] + 0.5) * 2 * WIDTH / BINS for r in cells])
    good = np.array([0.0 if r["rejected"] else 1.0 for r in cells])
    n = np.array([float(r["n"]) for r in cells])
    if len(np.unique(good)) < 2:
        return Model(ratio, 1.0, 0.0)
    # The classes count alike, so the verdict does not follow how many URLs rules happen to cover.
    share = np.array([n[good == g].sum() for g in (0.0, 1.0)])
    copies = np.maximum(1, np.round(200 * n / share[good.astype(int)])).astype(int)
    w = fit_logistic(np.repeat(x, copies), np.repeat(good, copies), ridge=1e-4)
    return Model(ratio, float(max(w[0], 0.0)), float(w[1]))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, score: rules first, the models for the rest."""
    found = ruled(pages, rules)
    labelled = found.filter("ruling is not null and url is not null").select("url", (F.col("ruling") == "block").alias("rejected"))
    scored = score(found, fit(labelled))
    by_model = F.when(F.col("score") >= 0.5, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("ruling", by_model).alias("verdict"), "score")


@query()
def op2_markov_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
