"""Predicates on values; null and empty values are always valid."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the pattern of a mainland mobile number.
MOBILE = r"^(?:(?:\+|00)86)?1(?:3[\d]|4[0,1,4-9]|5[0-3,5-9]|6[2,5-7]|7[0-8]|8[\d]|9[0-3,5-9])\d{8}$"


def _or_empty(c: Column, condition: Column) -> Column:
    return F.coalesce((c == "") | condition, F.lit(True))


def matches(c: Column, pattern: str) -> Column:
    return _or_empty(c, c.rlike(f"^(?:{pattern})$"))


def mobile(c: Column) -> Column:
    return _or_empty(c, c.rlike(MOBILE))


def in_enum(c: Column, values: list) -> Column:
    return F.coalesce(c.isin(values), F.lit(True))


def in_dict(c: Column, values: list[str]) -> Column:
    """Membership whatever the letter case."""
    return _or_empty(c, F.lower(c).isin([v.lower() for v in values]))


def safe_path(c: Column) -> Column:
    """A relative path without a backslash, NUL, drive letter, or an empty, . or .. part."""
    parts = F.split(c, "/")
    return ~c.startswith("/") & ~c.contains("\\") & ~c.contains("\0") & ~c.rlike("^[A-Za-z]:") & F.forall(parts, lambda p: ~p.isin("", ".", ".."))
