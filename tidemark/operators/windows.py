"""Latest rows, samples, budgets and runs, by window functions with explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import checkpointed


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order given."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def balanced_sample(df: DataFrame, group: str, per_group: int, total: int, order: list[Column]) -> DataFrame:
    """At most per_group rows of each group and total of all, by group and order."""
    kept = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= per_group)
    return kept.orderBy(group, "_n").limit(total).drop("_n")


def numbered(df: DataFrame, keys: list[str], order: list[Column], number: str, total: str) -> DataFrame:
    """df with each row's number in its key, from 0, and the key's number of rows.

    A key may hold any share of the rows: Spark deals them by key and order to ranges of about equal
    size, each range counts for itself, and what came before is added.
    """
    ranged = checkpointed(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_here"))
    w = Window.partitionBy(*keys)
    told = counts.select(*keys, "_range", (F.sum("_here").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_here")).alias("_before"), F.sum("_here").over(w).alias(total))  # a key's ranges
    here = ranged.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1)
    same = [here[k].eqNullSafe(told[k]) for k in keys] + [here["_range"] == told["_range"]]
    joined = here.join(told, same)
    return joined.select(*[here[c] for c in df.columns], (F.col("_before") + F.col("_at")).alias(number), F.col(total))


def even_sample(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """limit rows of each key at even distances, the first and the last among them; all if there are no more."""
    numbers = numbered(df, keys, order, "_i", "_n")
    # Row i is taken if it is round(j * (n - 1) / (limit - 1)) for some j < limit.
    j = F.floor(F.col("_i") * F.lit(limit - 1) / (F.col("_n") - 1) + 0.5)
    near = lambda k: F.floor(k * (F.col("_n") - 1) / F.lit(limit - 1) + 0.5) == F.col("_i")
    hit = (near(j) & (j < limit)) | (near(j - 1) & (j >= 1)) | (near(j + 1) & (j + 1 < limit))
    return numbers.where((F.col("_n") <= limit) | hit).drop("_i", "_n")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows in order while the running sum of size fits the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(size).over(w)).where(F.col("_used") <= budget).drop("_used")


def runs(df: DataFrame, keys: list[str], order: list[Column], flag: Column) -> DataFrame:
    """Gaps and islands: keys, run, n, and the first and last position of each unbroken run of rows with the flag."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_f", flag).withColumn("_p", F.row_number().over(w))
    marked = marked.withColumn("_g", F.col("_p") - F.row_number().over(Window.partitionBy(*keys, "_f").orderBy(*order))).where("_f")
    return marked.groupBy(*keys, F.col("_g").alias("run")).agg(F.count("*").alias("n"), F.min("_p").alias("first"), F.max("_p").alias("last"))
