"""Mix sources to target weights by Poisson replication, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import table, written

#: Sources whose rates are broadcast; with more of them the rates are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Largest mean that one draw inverts: a larger one is the sum of independent draws of equal means.
_LARGE = 500.0


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text", scale: float = 1.0) -> DataFrame:
    """source, chars, rate: the mean number of times that a document of the source is repeated.

    rate = scale * (weight / sum of weights) * all chars / the source's chars.  Without weights all
    sources weigh alike; a source that the weights omit gets 0.  A source without any character is
    repeated ``scale`` times.  A null source is a source of its own, weighed by the key "".
    """
    chars = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")).alias("chars"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.coalesce("source", F.lit("")) == name, F.lit(float(w))).otherwise(weight)
    weighed = chars.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0)))
    totals = weighed.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("chars") > 0, F.lit(float(scale)) * F.col("weight") * F.col("all_chars") / (F.col("all_weight") * F.col("chars"))).otherwise(F.lit(float(scale)))
    return weighed.crossJoin(F.broadcast(totals)).select("source", "chars", rate.alias("rate"))  # totals: one row


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", scale: float = 1.0) -> DataFrame:
    """The rows of docs, each as often as a Poisson draw says, shuffled; with rate, n_copies, copy_no and shuffle_key.

    The draw inverts the Poisson distribution of the source's rate at a uniform number hashed from
    (seed, id), so a rerun, on whatever partitions, gives the same rows; rows of one id get one
    count.  A rate above 500 is the sum of independent draws of equal means of at most 500, each
    inverted at a number of its own, which is again exactly Poisson.  A row with a null id is hashed by its text.  Rows are dealt to partitions by hash and
    sorted there by shuffle_key (also hashed), which is a global shuffle without a sampling pass.
    Columns of docs that bear a name of the four new ones are replaced.
    """
    new = ["rate", "n_copies", "copy_no", "shuffle_key"]
    docs = docs.drop(*[c for c in new if c in docs.columns])
    rates = written(source_rates(docs, weights, source_col, text_col, scale), "rates")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / _LARGE)).cast("int")
    drawn = rates.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    steps = F.sequence(F.lit(1), (F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int"))
    zero = F.exp(-F.col("mean"))
    terms = F.aggregate(
        steps,
        F.struct(zero.alias("p"), F.array(zero).alias("c")),
        lambda s, k: F.struct((s["p"] * F.col("mean") / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * F.col("mean") / k)).alias("c")),
        lambda s: s["c"],
    )
    drawn = written(drawn.select(F.col("source").alias("of"), "rate", "parts", terms.alias("cdf")), "cdf")
    if drawn.count() <= BROADCAST_SOURCES:
        drawn = F.broadcast(drawn)
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))

    def hashed(*parts: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary")), 1, 13), 16, 10).cast("long")

    def inverted(u: Column) -> Column:
        """The count whose share of the distribution holds u."""
        return F.size(F.filter("cdf", lambda c: c <= u / F.lit(float(1 << 52))))

    # The row's own columns lie in one struct, so that none of them can clash with those made here.
    named = docs.select(F.struct("*").alias("row"), name.alias("name"), F.col(source_col).alias("source"))
    rows = named.join(drawn, F.col("source").eqNullSafe(F.col("of")))
    more = F.transform(F.sequence(F.lit(2), F.greatest("parts", F.lit(2))), lambda i: F.when(i <= F.col("parts"), inverted(hashed(F.col("name"), F.lit("part"), i.cast("string")))).otherwise(0))
    count = inverted(hashed(F.col("name"))) + F.when(F.col("parts") > 1, F.aggregate(more, F.lit(0), lambda a, b: a + b)).otherwise(0)
    rows = rows.withColumn("n_copies", count.cast("long"))
    copies = rows.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", hashed(F.col("name"), F.col("copy_no").cast("string")))
    return keyed.select("row.*", *new).repartition("shuffle_key").sortWithinPartitions("shuffle_key", id_col)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE chars AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY source),
totals AS (SELECT CAST(sum(chars) AS BIGINT) AS all_chars, CAST(count(*) FILTER (WHERE chars > 0) AS DOUBLE) AS all_weight FROM chars),
rates AS (SELECT source, CASE WHEN chars > 0 THEN 1.0::DOUBLE * 1.0::DOUBLE * all_chars / (all_weight * chars) ELSE 1.0::DOUBLE END AS rate FROM chars, totals),
means AS (SELECT source, rate, greatest(1, CAST(ceil(rate / 500) AS INT)) AS parts, rate / greatest(1, CAST(ceil(rate / 500) AS INT)) AS mean FROM rates),
cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < CAST(floor(mean + 12 * sqrt(mean) + 40) AS INT)),
parted AS (SELECT d.*, rate, unnest(range(1, parts + 1)) AS part FROM documents d JOIN means m ON m.source IS NOT DISTINCT FROM d.source),
drawn AS (SELECT *, CAST('0x' || substr(md5('mix-1|' || doc_id || CASE WHEN part > 1 THEN '|part|' || part ELSE '' END), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM parted),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rate, count(*) FILTER (WHERE c.c <= d.u) AS n_copies
  FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, rate, n_copies, copy_no, CAST('0x' || substr(md5('mix-1|' || doc_id || '|' || copy_no), 1, 13) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM counted WHERE n_copies > 0)
"""
