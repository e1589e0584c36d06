"""Dictionary columns: value to label and back."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F


def translate(c: Column, labels: dict[str, str]) -> Column:
    """The label of a value; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*labels.items())]), c)


def label_join(df: DataFrame, dictionary: DataFrame, kind: str, value_col: str, label_col: str) -> DataFrame:
    """df with the label of value_col from dictionary(type, value, label); unknown values have null."""
    part = dictionary.where(F.col("type") == kind).select(F.col("value").alias("_value"), F.col("label").alias(label_col))
    return df.join(part, F.col(value_col).cast("string") == F.col("_value"), "left").drop("_value")
