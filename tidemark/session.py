"""Session factory with the settings that the library's semantics rest on."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark then drops the shuffle files of a query that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and skew joins on, checkpoints deleted with their frames; anything in conf wins (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    settings |= {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; one of our own only where none is set, on one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application for files that a query derives."""
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into spark.checkpoint.dir, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in a working folder and read again: smaller than a checkpoint, and deleted by ``dropped``."""
    spark, path = df.sparkSession, working_folder(df.sparkSession, name)
    with _lock:  # the setting is the session's
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.saved_to = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``saved`` that nothing reads any more."""
    for t in tables:
        folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.saved_to)
        folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
