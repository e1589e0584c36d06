"""JSON out of free text, and tolerant reading."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_object(c: Column) -> Column:
    """From the first { to the last }, null without both."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def first_array(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?s)\[.*\]", 0), F.lit(""))


def numbers(c: Column, size: Column | None = None) -> Column:
    """An array of numbers in a text; null if there is none or its size differs."""
    found = F.from_json(first_array(c), "array<double>")
    return found if size is None else F.when(F.size(found) == size, found)


def is_json(c: Column) -> Column:
    return F.coalesce(F.is_variant_null(F.try_parse_json(c)).isNotNull(), F.lit(False))
