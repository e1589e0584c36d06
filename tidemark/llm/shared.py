"""Tables that cut a job's lineage, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then drops the shuffle files of a query that has ended; a written table does not need them any more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders written since each open ``working_tables``.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where the session has none and runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which ``clear`` deletes."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again; survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    for scope in _scopes:
        scope.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more, not even a frame that is still to be computed."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted when the block ends without an error, but for those that were added to the list it gives."""
    made: list[str] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.remove(made)
    for path in set(made) - {t.written_to for t in kept}:
        _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written here; for its end, when the results are saved elsewhere."""
    _delete(spark, own_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
