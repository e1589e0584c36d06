"""Sentences, tokens and greedy packing, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def estimate_tokens(c: Column) -> Column:
    """ceil(length / 1.5); null is 0."""
    return F.coalesce(F.ceil(F.length(c) / 1.5), F.lit(0)).cast("int")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\n\s*\n")
    return F.filter(F.transform(parts, trim), lambda p: p != "")


def trim(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def sentences(c: Column) -> Column:
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), "([。！？.!?])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), trim), lambda s: s != "")


def pack(parts: Column, budget: Column, separator: str = "") -> Column:
    """Greedy packing: a block is closed when the next part would exceed the budget; a part that is too long stays whole."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["cur"] != "") & (estimate_tokens(s["cur"]) + estimate_tokens(x) > budget)
        grown = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(separator), x))
        return F.struct(F.when(full, x).otherwise(grown).alias("cur"), F.when(full, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["cur"] != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))


def last_sentences(c: Column, n: int) -> Column:
    s = sentences(c)
    return F.when(F.size(s) <= n, c).otherwise(F.array_join(F.slice(s, -n, n), ""))


def overlapped(blocks: Column, n: int) -> Column:
    """Each block after the first is led by the last n sentences of the block before, as it was."""
    if n <= 0:
        return blocks
    return F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.concat(last_sentences(F.get(blocks, i - 1), n), b)))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits; runs with Chinese characters become their character pairs."""
    text = F.lower(F.coalesce(c, F.lit("")))
    words = F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")

    def cut(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
        return F.when(w.rlike("[一-鿿]"), pairs).otherwise(F.array(w))

    return F.when(text.rlike("[一-鿿]"), F.flatten(F.transform(words, cut))).otherwise(words)
