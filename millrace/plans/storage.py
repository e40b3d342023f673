"""Tables in the folder that driver and executors share.

Iterative plans cut their lineage by writing a table there and reading it back, so a lost
executor costs a re-read and never a re-run of earlier rounds.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_TRACKERS: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The application's part of ``spark.checkpoint.dir``; where that is unset and Spark runs in one process, of a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The shuffle files of the plan that made it are of no use any more and go at once.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    for paths in _TRACKERS:
        paths.append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` returned and that no plan will read again."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            delete(df.sparkSession, path)


@contextlib.contextmanager
def tracked() -> Iterator[list[str]]:
    """The paths that ``stored`` writes meanwhile."""
    paths: list[str] = []
    _TRACKERS.append(paths)
    try:
        yield paths
    finally:
        _TRACKERS.remove(paths)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, whichever file system holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
