"""Character similarities and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def normalized(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def multiset(df: DataFrame, keys: list[str], a: str, b: str, name: str = "similarity") -> DataFrame:
    """keys and 2 * shared characters / all characters of a and b, spaces and case aside; both empty is 1, one empty 0."""
    x, y = normalized(F.coalesce(F.col(a), F.lit(""))), normalized(F.coalesce(F.col(b), F.lit("")))
    sides = df.select(*keys, x.alias("_a"), y.alias("_b"))
    chars = sides.select(*keys, F.explode(F.concat(F.transform(F.split("_a", ""), lambda c: F.struct(c.alias("c"), F.lit(1).alias("l"), F.lit(0).alias("r"))), F.transform(F.split("_b", ""), lambda c: F.struct(c.alias("c"), F.lit(0).alias("l"), F.lit(1).alias("r"))))).alias("e"))
    shared = chars.where("e.c <> ''").groupBy(*keys, "e.c").agg(F.least(F.sum("e.l"), F.sum("e.r")).alias("n")).groupBy(*keys).agg(F.sum("n").alias("_n"))
    la, lb = F.length("_a"), F.length("_b")
    value = F.when((la == 0) & (lb == 0), 1.0).when((la == 0) | (lb == 0), 0.0).otherwise(2.0 * F.coalesce("_n", F.lit(0)) / (la + lb))
    return sides.join(shared, keys, "left").select(*keys, value.alias(name))


def jaccard(a: Column, b: Column) -> Column:
    """Shared characters / all characters, as sets, of the texts as they are; null or no character gives 0."""
    x, y = (F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda ch: ch != "")) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(a.isNull() | b.isNull() | (union == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def min_max(score: Column, keys: list[str]) -> Column:
    """Scores of a batch on 0 .. 1; null and negative ones count as 0, and a flat batch is all 1."""
    w, s = Window.partitionBy(*keys), F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0))
    lo, hi = F.min(s).over(w), F.max(s).over(w)
    return F.when(hi - lo < 1e-9, 1.0).otherwise((s - lo) / (hi - lo))
