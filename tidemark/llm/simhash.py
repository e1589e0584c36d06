"""SimHash fingerprints and Hamming-radius search, in DataFrame functions alone.

Each word votes with its 64-bit hash, weighted by its length, so that the short function words
of a language do not decide.  The 64 tallies are packed four to a long, sixteen bits each, in
sixteen sums; a text is tallied in runs of ``_RUN`` words, so that no lane can overflow however
long the text is, and the runs are added up afterwards.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import discard, table, written

_RUN, _HEAVIEST = 4096, 7  # _RUN * _HEAVIEST < 2**15
_LANES = 0x0001000100010001
_BINS = 4096  # ranges that the documents are ordered in, at most


def _tallies(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint (long) of texts(keys, text); one row for each row, if keys are unique."""
    words = texts.select(*keys, F.posexplode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[\\x20\\x09-\\x0D]+")).alias("at", "word"))
    size = F.length("word").cast("long")
    votes = words.select(*keys, (F.col("at") / F.lit(_RUN)).cast("int").alias("run"), F.xxhash64("word").alias("h"), F.when(size == 0, F.lit(0).cast("long")).otherwise(F.least(F.greatest(size - 2, F.lit(1)), F.lit(_HEAVIEST)).cast("long")).alias("w"))
    sums = [F.sum(F.shiftright("h", j).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"s{j}") for j in range(16)]
    runs = votes.groupBy(*keys, "run").agg(F.sum("w").alias("total"), *sums)
    lanes = [F.sum(F.shiftrightunsigned(f"s{j}", 16 * k).bitwiseAND(F.lit(0xFFFF))).alias(f"b{16 * k + j}") for k in range(4) for j in range(16)]
    whole = runs.groupBy(*keys).agg(F.sum("total").alias("total"), *lanes)
    bits = F.lit(0).cast("long")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return whole.select(*keys, bits.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def as_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long): one row per distinct (id, text).

    Equal texts have equal fingerprints; null, empty and blank texts have 0.  A null id is kept.
    Letter case does not count.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _tallies(rows.withColumn("t", F.xxhash64("text")), ["doc_id", "t"]).select("doc_id", "fingerprint")


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, fingerprint, distance) for all distinct fingerprints within the Hamming radius of each distinct query.

    The 64 bits are cut into ``blocks``; two fingerprints within the radius agree on at least
    ``blocks - radius`` of them, so each choice of that many blocks is a permuted table whose
    leading bits are a join key.  Equal fingerprints are collapsed first (join to expand), and a
    pair counts only in the first table where it meets.  Both inputs need a column fingerprint
    (long); nulls are dropped.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64 is needed")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << j for j in range(edges[i], edges[i + 1])) for i in range(blocks)]
    choices = list(combinations(range(blocks), blocks - radius))

    def masked(c: Column, m: int) -> Column:
        return c.bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m))

    def tables(df: DataFrame, name: str) -> DataFrame:
        f = df.where("fingerprint IS NOT NULL").select(F.col("fingerprint").alias(name)).distinct()
        return f.select(name, F.posexplode(F.array(*[masked(F.col(name), sum(masks[i] for i in c)) for c in choices])).alias("t", "k"))

    found = tables(queries, "query").join(tables(prints, "fingerprint"), ["t", "k"])
    differing = F.col("query").bitwiseXOR(F.col("fingerprint"))
    agree = [F.when(masked(differing, m) == 0, 1).otherwise(0) for m in masks]
    first = F.coalesce(*[F.when(sum((agree[i] for i in c), F.lit(0)) == len(c), F.lit(n)) for n, c in enumerate(choices)])
    return found.withColumn("distance", F.bit_count(differing)).where((F.col("distance") <= radius) & (F.col("t") == first)).select("query", "fingerprint", "distance")


def _chained(keys: DataFrame, per_bin: int) -> DataFrame:
    """keys(z, k, t, n_chars, times; z, k, t unique) with structs following and previous: the neighbours in the order of z, k, t, in a ring.

    Spark cuts the order into ranges of about equal size, whatever the distribution of the ids; each
    range is numbered by itself, and the ends of the ranges, at most ``_BINS``, are tied together.
    """
    keys = written(keys, "keys")
    bins = max(1, min(_BINS, -(-keys.count() // per_bin)))
    placed = written(keys.repartitionByRange(bins, "z", "k", "t").withColumn("bin", F.spark_partition_id()), "placed")
    own = F.struct("z", "k", "t", "n_chars", "times")
    ends = placed.groupBy("bin").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    along, all_ = Window.partitionBy(F.lit(0)).orderBy("bin"), Window.partitionBy(F.lit(0))  # at most _BINS rows
    ends = ends.select("bin", F.coalesce(F.lead("first").over(along), F.min("first").over(all_)).alias("after"), F.coalesce(F.lag("last").over(along), F.max("last").over(all_)).alias("before"))
    w = Window.partitionBy("bin").orderBy("z", "k", "t")
    inside = placed.withColumn("following", F.lead(own).over(w)).withColumn("previous", F.lag(own).over(w))
    out = inside.join(F.broadcast(ends), "bin").withColumns({"following": F.coalesce("following", "after"), "previous": F.coalesce("previous", "before")})
    out = written(out.drop("bin", "after", "before"), "chain")
    discard(keys, placed)
    return out


def edit_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bin: int = 4096) -> DataFrame:
    """Fingerprint each text and an edited copy: its last quarter replaced by the start of the next document.

    One row per row of docs: doc_id, n_chars, edited_sha256, print (long), fingerprint and
    edited_fingerprint (hex), near_edited, near_next.  The next document is the one with the next
    larger id, after the last the first; rows of one id follow each other in the order of a hash of
    their texts, and rows with a null id come first.  Ids must be whole numbers.  Null texts count as empty.  Of equal rows
    each is followed by the next of them.  Texts are shuffled once, and of each once more no
    more than what the document before it takes over.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.col("doc_id").isNotNull().cast("int").alias("z"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("k"), F.xxhash64("text").alias("t"), "text")
    key = ["z", "k", "t"]
    chain = _chained(rows.groupBy(*key).agg(F.max(F.char_length("text")).alias("n_chars"), F.count("*").alias("times")), per_bin)
    several = not chain.where("times > 1").isEmpty()
    texts = rows.dropDuplicates(key) if several else rows
    quarter = lambda n: F.floor(n / 4).cast("int")
    taken = texts.join(chain.select(*key, "previous"), key)
    taken = taken.select(*[F.col(f"previous.{c}").alias(c) for c in key], F.struct(*key).alias("next"), "previous.times", F.substring("text", F.lit(1), quarter(F.col("previous.n_chars"))).alias("after"))
    n_chars = F.char_length("text")
    own = F.substring("text", F.lit(1), (n_chars - quarter(n_chars)).cast("int"))
    both = texts.join(taken, key)
    edited, again = F.concat(own, "after"), F.concat(own, F.substring("text", F.lit(1), quarter(n_chars)))
    facts = both.select(*key, "next", "times", n_chars.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("sha"), F.when(F.col("times") > 1, F.sha2(again, 256)).alias("sha_again"))
    variants = F.when(F.col("times") > 1, F.array("text", edited, again)).otherwise(F.array("text", edited))
    sides = both.select(*key, F.posexplode(variants).alias("side", "text"))
    prints = _tallies(sides, [*key, "side"])
    prints = prints.groupBy(*key).agg(*[F.max(F.when(F.col("side") == i, F.col("fingerprint"))).alias(name) for i, name in enumerate(("print", "edited_print", "again_print"))])
    done = written(facts.join(prints, key), "prints")
    nexts = done.select(F.struct(*key).alias("next"), F.col("print").alias("next_print"))
    plain = done.join(nexts, "next").select(*key, "n_chars", "sha", "print", "edited_print", "next_print")
    if several:
        copies = done.where("times > 1").withColumn("i", F.explode(F.sequence(F.lit(2).cast("long"), F.col("times"))))
        plain = plain.unionByName(copies.select(*key, "n_chars", F.col("sha_again").alias("sha"), "print", F.col("again_print").alias("edited_print"), F.col("print").alias("next_print")))
    return plain.select(
        F.when(F.col("z") == 1, F.col("k")).alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        "print",
        as_hex(F.col("print")).alias("fingerprint"),
        as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edit_check of all documents; n_within, for ids divisible by 50: the documents whose fingerprint is within 3 bits, itself included."""
    checked = written(edit_check(table(spark, sf_dir, "documents")), "checked")
    counts = checked.groupBy(F.col("print").alias("fingerprint")).agg(F.count("*").alias("n"))
    asked = checked.where("doc_id % 50 = 0").select(F.col("print").alias("fingerprint"))
    within = within_radius(counts, asked).join(counts, "fingerprint").groupBy("query").agg(F.sum("n").alias("n_within"))
    out = checked.join(within, (checked["print"] == within["query"]) & (checked["doc_id"] % 50 == 0), "left")
    return out.drop("print", "query")
