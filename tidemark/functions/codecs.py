"""Columns that hold lists, ciphers or signatures as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def encode_list(c: Column, distinct: bool = False) -> Column:
    return F.array_join(F.transform(F.array_distinct(c) if distinct else c, lambda x: x.cast("string")), ",")


def decode_list(c: Column, element: str = "long", distinct: bool = False) -> Column:
    """A comma list; blank gives an empty list."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x) != "")
    out = F.transform(parts, lambda x: F.trim(x).cast(element))
    return F.array_distinct(out) if distinct else out


def encrypt(c: Column, key: str) -> Column:
    return F.base64(F.aes_encrypt(c.cast("binary"), F.lit(key)))


def decrypt(c: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(c), F.lit(key)).cast("string")


def told_map(m: Column) -> Column:
    """key=value of a map, by key, joined by &."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")


def signature(params: Column, body: Column, headers: Column, secret: str) -> Column:
    """SHA-256 of the sorted parameters, the body, the sorted headers and the secret; params and headers are maps."""
    return F.sha2(F.concat(told_map(params), F.coalesce(body, F.lit("")), told_map(headers), F.lit(secret)), 256)


def signature_fresh(timestamp: Column, now: Column, nonce: Column, timeout_seconds: int) -> Column:
    """Not older or newer than the timeout, with a nonce of ten characters or more."""
    return (F.abs(F.unix_timestamp(now) - F.unix_timestamp(timestamp)) <= timeout_seconds) & (F.length(nonce) >= 10)
