"""Shared working folder: written tables, checkpoints of streams, saved models.

A cluster names a folder every executor can reach in ``spark.checkpoint.dir``; that setting is read from
the session.  Only a local session without the setting gets a fresh temporary folder.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark's setting by which the shuffle files of an action go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WRITING = threading.Lock(), {}


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="ardoise-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used, below the shared folder."""
    return f"{shared_dir(spark)}/ardoise/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go with the end of the write: nobody reads them again.

    Several threads may write at once; the session's own setting is back when the last one is done.
    """
    app = spark.sparkContext.applicationId
    with _LOCK:
        writers, before = _WRITING.get(app, (0, None))
        if not writers:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _WRITING[app] = (writers + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            writers, before = _WRITING[app]
            if writers == 1:
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
            _WRITING[app] = (writers - 1, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the table once and go on from the written copy.

    Cuts the lineage before several passes over the same wide table: the passes are then column-pruned
    scans, and a lost executor costs a re-read instead of the whole pipeline.  The shuffle files go at once.
    """
    path = fresh_path(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
