"""Drop lines that an earlier document has, in DataFrame functions alone.

Lines are exploded by their normalised keys' 128-bit hashes, the documents of each hash are counted,
and the lines of frequent hashes go back to their documents as positions: only hashes and positions
are shuffled by line, and each text travels once, to the positions that it loses.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import discard, table, written

_SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_SPACES))
    plain = F.octet_length(bare) == F.char_length(bare)  # only ASCII: the quick function does the same
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: row (a struct of all its columns), text without the repeated lines, n_lines, n_dropped.

    A text is split at \\n; a null or empty one is one empty line.  A line whose key (``line_key``) has
    at least min_chars code points and occurs in at least min_docs documents is dropped, except in
    the smallest of these documents, where all its lines stay.  Rows of one id are one document.
    Rows with a null id are one document that comes after all others.  The docs' own columns,
    whatever their names, stay apart in the struct.  An empty table gives no rows.
    """
    row, name, text, mark = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.struct
    # A document: 0 and its id, or 1 for the null id.  A row: its document and two hashes of its text.
    document = mark(F.when(name.isNull(), 1).otherwise(0).alias("z"), name.alias("k"))
    texts = docs.select(document.alias("document"), mark(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b")).alias("t"), _lines(text).alias("lines"))
    keyed = texts.select("document", "t", F.posexplode("lines").alias("at", "line")).select("document", "t", "at", line_key(F.col("line")).alias("key"))
    lines = written(keyed.where(F.char_length("key") >= min_chars).select("document", "t", "at", _hash(F.col("key")).alias("h")), "line_hashes")
    counted = lines.select("h", "document").distinct().groupBy("h").agg(F.count("*").alias("n"), F.min("document").alias("first"))
    frequent = written(counted.where(F.col("n") >= min_docs).select("h", "first"), "frequent_lines")
    lost = lines.join(frequent, "h").where(F.col("document") != F.col("first"))
    lost = written(lost.groupBy("document", "t").agg(F.collect_set("at").alias("lost")), "lost_lines")
    discard(frequent, lines)
    met = docs.select(row.alias("row"), document.alias("document"), mark(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b")).alias("t"))
    met = met.join(lost, (met["document"]["z"] == lost["document"]["z"]) & met["document"]["k"].eqNullSafe(lost["document"]["k"]) & (met["t"] == lost["t"]), "left")
    parts = _lines(F.col(f"row.`{text_col}`"))
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "lost"), lambda i: mark(i.alias("at"), F.lit(True).alias("stays")))
    goes = F.transform("lost", lambda i: mark(i.alias("at"), F.lit(False).alias("stays")))
    # Sorted by position, the marks lie beside the lines: no line is looked up by its number.
    left = F.zip_with(parts, F.sort_array(F.concat(stays, goes)), lambda line, m: F.when(m["stays"], line))
    kept = F.when(F.col("lost").isNull(), F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))).otherwise(F.array_join(left, "\n"))
    return met.select("row", kept.alias("text"), F.size(parts).cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = """
WITH l AS (
  SELECT doc_id, pos, list_extract(parts, pos) AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(k.doc_id <> f.first, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
