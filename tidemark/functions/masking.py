"""Masking and trimming of strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def slider(c: Column, prefix: int, suffix: int, replacer: str = "*") -> Column:
    """Keep the first and last characters; a value that has no more than these is masked whole."""
    n = F.length(c)
    middle = n - (prefix + suffix)
    whole = F.repeat(F.lit(replacer), n)
    kept = F.concat(F.substring(c, 1, prefix), F.repeat(F.lit(replacer), middle), F.substring(c, n - suffix + 1, F.lit(suffix)) if suffix else F.lit(""))
    return F.when(c.isNull(), None).when(middle <= 0, whole).otherwise(kept)


#: Characters kept at the start and the end.
PRESETS = {"mobile": (3, 4), "id_card": (6, 2), "bank_card": (6, 2), "fixed_phone": (4, 2), "car_license": (3, 1), "chinese_name": (1, 0), "password": (0, 0)}


def preset(c: Column, name: str) -> Column:
    return slider(c, *PRESETS[name])


def by_regex(c: Column, pattern: str = r"^[\s\S]*$", replacement: str = "******") -> Column:
    return F.regexp_replace(c, pattern, replacement)


def email(c: Column) -> Column:
    return F.regexp_replace(c, r"(^.)[^@]*(@.*$)", "$1****$2")


def max_length(c: Column, n: int) -> Column:
    """At most n characters: a longer text loses its end to three dots."""
    return F.when(F.length(c) > n - 3, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def strip_html(c: Column) -> Column:
    """Text without scripts, styles, comments and tags: an approximation of an allow-list cleaner that keeps no tag."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")


def remove_lines_containing(c: Column, part: str) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.contains(part)), "\n")
