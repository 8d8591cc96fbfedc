"""Corpus pipeline: from raw documents to token ids.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next one's docs.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import compression, decontaminate, neardup, pieces, pii
from rasterloom.llm.common import fold, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ACCEPT = 0.3                # quality score from which a document stays
SHINGLE, PERCENT = 5, 80    # words of a shingle, similarity of near duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    model = compression.fit(docs, table(spark, sf_dir, "labels"),
                            keep=fold("doc_id", compression.FOLDS) != compression.HELD_OUT)
    return (compression.score(docs.select(*COLUMNS), model, name="_score")
            .filter(F.col("_score") >= ACCEPT).select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.deduplicate(docs.select(*COLUMNS), SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked; n_chars follows the text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids per document by digest, encoded and decoded again."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: Trained models and token ids cannot be told in SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
