"""Learned quality rules: an ordered decision list over text statistics.

Sequential covering on labelled statistics.  Each rule is a conjunction of thresholds
that covers mostly bad texts; it is grown on two thirds of the texts still uncovered,
pruned on the other third, and kept while it holds there.  The list becomes one ordered
Spark conditional expression.

Defined results: null and empty texts have all statistics 0; rows are judged one by one,
so repeated rows get equal verdicts and no row is lost; with no labels, or labels of
one class only, the list is empty and keeps everything.  Other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, table
from .registry import query

#: White space, symbols and the length of a repeat window of the base rules.
BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_distinct", "n_upper", "n_digits", "n_marks", "n_lines"]
STATS_TYPE = ", ".join(f"{c} long" for c in COUNTS)

#: Ratios that rules may test, as Spark expressions of the counts.
RATIOS: dict[str, str] = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
}
SAMPLE = 20_000         # labelled texts used for fitting
LONGEST, MOST = 3, 12   # conditions of a rule, rules of a list
PRECISION = 0.8         # of a rule on the texts that prune it
CUTS = 64               # thresholds tried per statistic

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?.,;:"


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS for one whole text."""
    raw = (text or "").encode()
    words = raw.split()         # bytes split at ASCII white space alone
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (n, len(text or "") - without(BLANK), without(SYMBOLS), len(lines) - len(set(lines)),
            _repeated(words), len(set(words)), without(_UPPER), without(_DIGITS), without(_MARKS), len(lines))


def _repeated(words: list[bytes]) -> int:
    """Words inside windows that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen: set[tuple[bytes, ...]] = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    total = stop = 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + WINDOW - max(i, stop)
            stop = i + WINDOW
    return total


def with_statistics(docs: DataFrame, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``columns`` and the counts of the column text, per row."""
    kept = docs.select(*columns, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.column(len(columns))], np.int64)
            found = found.reshape(batch.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(found[:, i]) for i in range(len(COUNTS)))],
                [*batch.schema.names[:-1], *COUNTS])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{types}, {STATS_TYPE}")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(RATIOS[self.name])
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        value = x[:, names.index(self.name)]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> Rule:
    """Add the condition with the largest information gain until only bad texts are covered."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < LONGEST and bad[inside].any() and (~bad)[inside].any():
        p0, n0 = bad[inside].sum(), (~bad)[inside].sum()
        before = np.log2(p0 / (p0 + n0))
        best, choice = 0.0, None
        for name in names:
            value = x[:, names.index(name)][inside]
            for cut in np.unique(np.quantile(value, np.linspace(0.005, 0.995, CUTS))):
                # A cut halfway to the next value, so that a threshold is no single text's value.
                higher = value[value > cut]
                if not len(higher):
                    continue
                middle = float((cut + higher.min()) / 2)
                for above in (True, False):
                    held = value > middle if above else value <= middle
                    p, n = bad[inside][held].sum(), (~bad)[inside][held].sum()
                    gain = p * (np.log2(p / (p + n)) - before) if p else 0.0
                    if gain > best + 1e-9:
                        best, choice = gain, Condition(name, above, middle)
        if choice is None:
            break
        rule += (choice,)
        inside &= choice.holds(x, names)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> float:
    held = _covers(rule, x, names)
    p, n = bad[held].sum(), (~bad)[held].sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> list[Rule]:
    """Ordered rules for bad texts; row order decides which third prunes."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < MOST and bad[left & ~third].any():
        grow, prune = left & ~third, left & third
        rule = _grow(x[grow], bad[grow], names)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)),
                   key=lambda r: _worth(r, x[prune], bad[prune], names))
        held = _covers(rule, x, names)
        p, n = bad[held & prune].sum(), (~bad)[held & prune].sum()
        if p < 2 or p / (p + n) < PRECISION:
            break
        rules.append(rule)
        left &= ~held
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None,
        sample: int = SAMPLE) -> list[Rule]:
    """Rules from the statistics of about ``sample`` labelled texts at most."""
    rows = labelled_sample(docs, labels, label, sample, keep)
    found = (with_statistics(rows, ("doc_id", "y"))
             .select("doc_id", "y", *(F.expr(e).alias(n) for n, e in RATIOS.items()))
             .orderBy(F.xxhash64("doc_id"), *RATIOS).toArrow())
    names = list(RATIOS)
    x = np.column_stack([found[n].to_numpy() for n in names]) if found.num_rows else np.zeros((0, len(names)))
    y = found["y"].to_numpy()
    return learn(x, y == 0, names) if len(np.unique(y)) > 1 else []


def verdict(rules: list[Rule]) -> Column:
    """First rule that fits decides: its number as ``rule`` and kept = false; else kept."""
    out = None
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, base counts, base_failed, rule (number of the rule that rejects, else null), kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (with_statistics(docs).withColumn("base_failed", failed).withColumn("rule", verdict(rules))
            .select("doc_id", *BASE, "base_failed", "rule",
                    (~F.col("base_failed") & F.col("rule").isNull()).alias("kept")))


@query()
def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
