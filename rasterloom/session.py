"""Spark session settings and durable cut points for iterative jobs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "rasterloom", master: str | None = None,
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the settings the library expects.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster so that the
    submit-time configuration wins.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder; set from ``spark.checkpoint.dir`` where the session has none yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            # local-cluster[...] has executors of its own: one machine only is local or local[...].
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError(
                    "set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which driver and executors share."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a
    local session without that setting gets a temporary folder, because there
    driver and executors share one disk.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writers, _writing = [], threading.Lock()


def append(df: DataFrame, path: str, *by: str, **options: str | int) -> None:
    """Add ``df`` to the Parquet table at ``path``; the shuffle files of this write are deleted when it ends.

    Writers side by side share the setting for that; the last one sets it back.
    """
    conf = df.sparkSession.conf
    with _writing:
        if not _writers:
            _writers.append(conf.get(_FILES, None))
            conf.set(_FILES, "true")
        _writers.append(path)
    try:
        df.write.options(**options).mode("append").partitionBy(*by).parquet(path)
    finally:
        with _writing:
            _writers.remove(path)
            if len(_writers) == 1:
                old = _writers.pop()
                conf.unset(_FILES) if old is None else conf.set(_FILES, old)
