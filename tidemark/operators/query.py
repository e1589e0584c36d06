"""Optional predicates, safe sorting, paging and membership in comma lists."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def present(value: object) -> bool:
    """Whether an optional predicate applies: None, blank text and empty collections don't."""
    if value is None:
        return False
    if isinstance(value, str):
        return value.strip() != ""
    if isinstance(value, (list, tuple, set, frozenset, dict)):
        return len(value) > 0
    return True


class Query:
    """Predicates that are left out when their value is missing.

    ``required=True`` on in_ keeps nothing for an empty collection instead of everything: a caller
    that filters by what a user may see must not lose its filter.
    """

    def __init__(self, df: DataFrame):
        self.df = df

    def _where(self, wanted: bool, condition) -> Query:
        return Query(self.df.where(condition())) if wanted else self

    def like(self, column: str, value: str | None) -> Query:
        return self._where(present(value), lambda: F.col(column).contains(value))

    def like_right(self, column: str, value: str | None) -> Query:
        return self._where(present(value), lambda: F.col(column).startswith(value))

    def in_(self, column: str, values: Iterable | None, required: bool = False) -> Query:
        values = list(values) if values is not None else []
        if not values and required:
            return Query(self.df.where(F.lit(False)))
        return self._where(bool(values), lambda: F.col(column).isin(values))

    def eq(self, column: str, value) -> Query:
        return self._where(present(value), lambda: F.col(column) == value)

    def ne(self, column: str, value) -> Query:
        return self._where(present(value), lambda: F.col(column) != value)

    def gt(self, column: str, value) -> Query:
        return self._where(present(value), lambda: F.col(column) > value)

    def ge(self, column: str, value) -> Query:
        return self._where(present(value), lambda: F.col(column) >= value)

    def lt(self, column: str, value) -> Query:
        return self._where(present(value), lambda: F.col(column) < value)

    def le(self, column: str, value) -> Query:
        return self._where(present(value), lambda: F.col(column) <= value)

    def between(self, column: str, low=None, high=None) -> Query:
        """Both ends inclusive; one missing end leaves the other."""
        return self.ge(column, low).le(column, high)

    def find_in_set(self, column: str, value: str | None) -> Query:
        return self._where(present(value), lambda: in_comma_list(F.col(column), value))

    def rows(self) -> DataFrame:
        return self.df

    def one(self) -> DataFrame:
        """At most one row; more are an error when it is computed."""
        two = self.df.limit(2)
        n = F.count("*").over(_everything())
        return two.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.lit(True)).cast("boolean")).drop("_n")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # over two rows at most


def in_comma_list(column: Column, value: str) -> Column:
    """Whether value is an element of a comma-separated list."""
    return F.array_contains(F.split(column, ","), value)


def snake(name: str) -> str:
    """camelCase to snake_case."""
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def safe_sort(df: DataFrame, wanted: list[tuple[str, str]], allowed: Iterable[str] | None = None) -> DataFrame:
    """Sort by (field, direction) pairs; fields are camelCase, unknown ones are ignored, only "asc" ascends."""
    allowed = set(df.columns if allowed is None else allowed)
    keys = [F.asc(c) if how == "asc" else F.desc(c) for c, how in ((snake(f), d) for f, d in wanted) if re.fullmatch(r"[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*", c) and c in allowed]
    return df.orderBy(*keys) if keys else df


@dataclass
class Page:
    """A page of rows, and the number of all (computed when asked for)."""

    rows: DataFrame
    whole: DataFrame

    @property
    def total(self) -> int:
        return self.whole.count()


def page(df: DataFrame, number: int = 1, size: int = 10, order: list[Column] | None = None) -> Page:
    """Page number (from 1) of the ordered rows; size -1 is all of them, and 200 the most."""
    ordered = df.orderBy(*order) if order else df
    if size == -1:
        return Page(ordered, df)
    if not 1 <= size <= 200 or number < 1:
        raise ValueError("1 <= size <= 200 and number >= 1 are needed")
    return Page(ordered.offset((number - 1) * size).limit(size), df)
