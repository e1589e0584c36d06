"""Date-range buckets, their labels, and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNITS = ("HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR")


def buckets(start: Column, end: Column, unit: str) -> Column:
    """Array of (start, end) structs: from the day of start to the end of end's day, cut at unit borders.

    Weeks begin on Monday.  The first bucket may begin inside a unit, the last ends with the range.
    """
    if unit not in UNITS:
        raise ValueError(unit)
    lo = F.date_trunc("DAY", start)
    hi = F.date_trunc("DAY", end) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    step = F.expr({"QUARTER": "INTERVAL 3 MONTH"}.get(unit, f"INTERVAL 1 {unit}"))
    starts = F.sequence(F.date_trunc(unit, lo), F.date_trunc(unit, hi), step)
    return F.transform(starts, lambda s: F.struct(F.greatest(s, lo).alias("start"), F.least(s + step - F.expr("INTERVAL 1 MICROSECOND"), hi).alias("end")))


def label(ts: Column, unit: str) -> Column:
    """How a bucket that starts at ts is named; the formats are fixed values."""
    if unit == "HOUR":
        return F.date_format(ts, "yyyy-MM-dd HH:mm")
    if unit == "DAY":
        return F.date_format(ts, "yyyy-MM-dd")
    if unit == "WEEK":
        return F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("(第 "), F.weekofyear(ts).cast("string"), F.lit(" 周)"))
    if unit == "MONTH":
        return F.date_format(ts, "yyyy-MM")
    if unit == "QUARTER":
        return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))
    return F.year(ts).cast("string")


def quarter_start(ts: Column) -> Column:
    return F.date_trunc("QUARTER", ts)


def month_end(ts: Column) -> Column:
    return F.date_trunc("MONTH", ts) + F.expr("INTERVAL 1 MONTH") - F.expr("INTERVAL 1 MICROSECOND")


def latest_days(today: Column, n: int) -> Column:
    """The n days that end with today."""
    return F.sequence(F.date_sub(today, n - 1), today)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)
