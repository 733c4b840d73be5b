"""Where lineage is cut: Parquet tables and reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Of written(): the folder of each frame, and the frames of the scratch() that is open.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)
#: Whether Spark removes the shuffle files of a query when it ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder, but only in local mode; on a cluster it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexiforge-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of this session: smaller than a checkpoint, and its size is known to the planner. Shuffle files of the write go as it ends."""
    spark = df.sparkSession
    path = f"{_session_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    _folders[found] = path
    if (made := _made.get()) is not None:
        made.append(found)
    return found


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed(*tables: DataFrame) -> None:
    """Remove tables that written() returned; frames that read them no longer work."""
    for table in tables:
        if path := _folders.pop(table, None):
            _delete(table.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that written() makes inside are removed at the end; frames that read them no longer work."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        removed(*made)


def clear(spark: SparkSession) -> None:
    """Remove the tables that written() made in this session; frames that read them no longer work."""
    _delete(spark, _session_folder(spark))
