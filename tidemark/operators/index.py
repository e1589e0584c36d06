"""The search index of chunks: entries and vectors by chunk id, written before a version's chunks become visible.

A chunk is found only while its status is PUBLISHED, so the status is the commit mark: it is set
last when a version is indexed and first when one is taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PUBLISHED, DISABLED = "PUBLISHED", "DISABLED"


def upsert(index: DataFrame, rows: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """The index with rows in place of those with their keys; of rows with one key the last in order."""
    if order is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).where("_n = 1").drop("_n")
    return index.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows.select(*index.columns))


def delete_keys(index: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The index without the given keys; keys that it lacks do no harm."""
    return index.join(keys.select(*key), key, "left_anti")


def entries_of(chunks: DataFrame) -> DataFrame:
    """What the text index holds of chunks(chunk_id, tenant_id, kb_id, content, ...)."""
    return chunks.select("chunk_id", "tenant_id", "kb_id", F.lit(PUBLISHED).alias("status"), "content")


def vectors_of(chunks: DataFrame) -> DataFrame:
    return chunks.where("embedding IS NOT NULL").select("chunk_id", "tenant_id", "kb_id", "embedding")


def index_version(chunks: DataFrame, entries: DataFrame, vectors: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, vectors and chunks after the versions(version_id) were indexed; doing it again changes nothing."""
    wanted = chunks.join(versions.select("version_id").distinct(), "version_id", "left_semi")
    return upsert(entries, entries_of(wanted), ["chunk_id"]), upsert(vectors, vectors_of(wanted), ["chunk_id"]), _with_status(chunks, versions, PUBLISHED)


def delete_version_index(chunks: DataFrame, entries: DataFrame, vectors: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, vectors and chunks after the versions were taken out of search; their chunks stay, DISABLED."""
    gone = chunks.join(versions.select("version_id").distinct(), "version_id", "left_semi").select("chunk_id")
    return delete_keys(entries, gone, ["chunk_id"]), delete_keys(vectors, gone, ["chunk_id"]), _with_status(chunks, versions, DISABLED)


def _with_status(chunks: DataFrame, versions: DataFrame, status: str) -> DataFrame:
    told = versions.select("version_id", F.lit(status).alias("_status")).distinct()
    return chunks.join(told, "version_id", "left").withColumn("status", F.coalesce("_status", "status")).select(*chunks.columns)


def publish(spark: SparkSession, chunks: DataFrame, folder: str) -> None:
    """Write the versions in chunks to folder/entries, /vectors and, last, /chunks, each partitioned by version.

    A version's partitions are overwritten, those of others stay, so a run that failed is simply run
    again: readers go by folder/chunks, which changes last.
    """
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        version = F.col("version_id")
        steps = [("entries", entries_of(chunks).join(chunks.select("chunk_id", version), "chunk_id")), ("vectors", vectors_of(chunks).join(chunks.select("chunk_id", version), "chunk_id")), ("chunks", chunks.withColumn("status", F.lit(PUBLISHED)))]
        for name, rows in steps:
            rows.write.mode("overwrite").partitionBy("version_id").parquet(f"{folder}/{name}")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def visible(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose chunk is published."""
    return entries.join(chunks.where(F.col("status") == PUBLISHED).select("chunk_id"), "chunk_id", "left_semi")


def row_ids(chunks: DataFrame, group: str, pos: str = "pos", parent_pos: str = "parent_pos", width: int = 1_000_000) -> DataFrame:
    """chunks with chunk_id and parent_id: group * width + position, so that a child's place in the list becomes its parent's id."""
    wide = chunks.where(F.col(pos) >= width).limit(1)
    number = lambda c: F.col(group) * width + F.col(c)
    if not wide.isEmpty():
        raise ValueError(f"a group has more than {width} chunks")
    return chunks.withColumn("chunk_id", number(pos)).withColumn("parent_id", number(parent_pos))
