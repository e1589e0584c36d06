"""Money, percentages and distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6378.137


def rate_price(price: Column, rate: Column, floor: bool = False) -> Column:
    """Cents of price at rate percent, rounded half up or down."""
    exact = price.cast("decimal(20,4)") * rate.cast("decimal(20,4)") / F.lit(100).cast("decimal(20,4)")
    return (F.floor(exact) if floor else F.round(exact, 0)).cast("long")


def price_multiply(price: Column, n: Column) -> Column:
    return F.round(price.cast("decimal(20,4)") * n.cast("decimal(20,4)"), 2).cast("decimal(20,2)")


def cents_to_units(cents: Column) -> Column:
    return F.round(cents.cast("decimal(20,4)") / 100, 2).cast("decimal(20,2)")


def scaled_total(price: Column, count: Column, percent: Column | None = None) -> Column:
    """price * count, times percent / 100 in whole numbers (so 0 below 100 percent)."""
    total = price.cast("long") * count.cast("long")
    return total if percent is None else total * F.floor(percent / 100).cast("long")


def product(*columns: Column) -> Column:
    """Null if any factor is."""
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance by the haversine formula, four decimals."""
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng1) - F.radians(lng2)) / 2), 2)
    return F.round(2 * F.asin(F.sqrt(half)) * EARTH_KM, 4)
