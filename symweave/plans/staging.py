"""Tables in the folder that all executors share.

A table goes when a later one replaces it (`replaces`), at the end of the `scratch()` in which it was written, or with the driver's JVM, even
where the session was stopped before.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths written in each open scratch(), innermost last.
_scopes: list[list[tuple[SparkSession, str]]] = []
#: Spark's setting under which the shuffle files of a query go when it ends; without it they stay until the driver's JVM happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Temporary folders of local sessions without a setting, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where no such setting exists and driver and executor are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="shared-")
            _leave(spark, _local[app])
        at = _local[app]
    return at.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _leave(spark: SparkSession, path: str) -> None:
    """Has the path deleted when the driver's JVM ends."""
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)


def dropped(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, replaces: tuple[DataFrame, ...] = (), lasting: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors.  What was shuffled for it goes at once.

    replaces: staged tables that nothing needs once this one is written.  lasting: the table outlives the scratch() around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes and not lasting:
        _scopes[-1].append((spark, path))
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    _leave(spark, path)
    for old in replaces:
        if hasattr(old, "_staged_at"):
            dropped(spark, old._staged_at)
    again = spark.read.schema(df.schema).parquet(path)
    again._staged_at = path
    return again


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one, gone as a staged table is."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((spark, path))
    _leave(spark, path)
    return path


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that are staged inside go at the end; a result that reads them must be written before."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            if spark.sparkContext._jsc is not None:
                dropped(spark, path)
