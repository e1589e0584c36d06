"""Changes to tables, as the rows that hold afterwards.  Nothing is changed in place: write the result to a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def update_by_id(base: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """Non-null fields of update replace base's, by key."""
    renamed = update.select(key, *[F.col(c).alias(f"_new_{c}") for c in update.columns if c != key])
    out = base.join(renamed, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in renamed.columns else F.col(c) for c in base.columns])


def soft_delete(df: DataFrame, condition: Column, flag: str = "deleted") -> DataFrame:
    return df.withColumn(flag, F.when(condition, F.lit(1)).otherwise(F.coalesce(F.col(flag), F.lit(0)) if flag in df.columns else F.lit(0)))


def retain(df: DataFrame, column: str, cutoff: Column) -> DataFrame:
    """What a retention delete leaves: one filter, not batches."""
    return df.where(F.col(column) >= cutoff)


def insert_missing(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """Rows of source whose key target lacks (insert-select with not-exists)."""
    return source.join(target.select(*on).distinct(), on, "left_anti")


def exclusive(df: DataFrame, chosen: Column, same_key: Column, status: str, on: int = 1, off: int = 0) -> DataFrame:
    """Enable the chosen row; siblings of its key that were enabled are disabled."""
    return df.withColumn(status, F.when(chosen, F.lit(on)).when(same_key & (F.col(status) == on), F.lit(off)).otherwise(F.col(status)))


def replace_from_source(base: DataFrame, fresh: DataFrame, key: list[str], source_col: str, generated: str, order: str) -> DataFrame:
    """Drop generated rows; add fresh ones whose key no other row has; of fresh rows with one key the first in order."""
    kept = base.where(~F.col(source_col).eqNullSafe(F.lit(generated)))
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
    return kept.unionByName(insert_missing(kept, first.withColumn(source_col, F.lit(generated)), key).select(*kept.columns))


def compare_and_set(df: DataFrame, column: str, moves: dict[str, tuple[str, Column]]) -> DataFrame:
    """Guarded state change: from state s to moves[s][0] where moves[s][1] holds; other rows stay."""
    new = F.col(column)
    for state, (to, when) in moves.items():
        new = F.when((F.col(column) == state) & when, F.lit(to)).otherwise(new)
    return df.withColumn(column, new)


def diff(old: DataFrame, new: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """key and change: create, update or delete; rows whose compared columns are equal are left out."""
    a = old.select(*key, F.struct(*compared).alias("_old"))
    b = new.select(*key, F.struct(*compared).alias("_new"))
    change = F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    return a.join(b, key, "full_outer").select(*key, change.alias("change")).where("change IS NOT NULL")
