"""Tables of a folder, and files that hold documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and column choices reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def area_csv(spark: SparkSession, path: str) -> DataFrame:
    """The area dictionary: id, name, type, parent_id; the first line is a header."""
    raw = spark.read.csv(path, header=True, schema="id LONG, name STRING, type INT, parentId LONG")
    return raw.withColumnRenamed("parentId", "parent_id")


def dispatch(documents: DataFrame, parsers: dict, type_col: str = "type") -> DataFrame:
    """Parse each type of document with its parser (DataFrame -> DataFrame); types without one go to parsers["*"]."""
    kind = F.upper(F.coalesce(F.col(type_col), F.lit("")))
    named = [k for k in parsers if k != "*"]
    parts = [parsers[k](documents.where(kind == k)) for k in named]
    if "*" in parsers:
        parts.append(parsers["*"](documents.where(~kind.isin(named))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
