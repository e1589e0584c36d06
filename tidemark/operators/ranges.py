"""Range lookup: the ranges that hold a point, by a sweep over sorted points and range starts; totals by running sums, without pairs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.session import saved

_AT_ONCE = 1 << 16  # rows of output that are held at once


def address_number(c: Column) -> Column:
    """A dotted address as a number; null where it is none: four parts of at most three digits up to 255."""
    parts = F.transform(F.split(F.trim(c), r"\."), lambda x: F.when(x.rlike(r"^\d{1,3}$"), x.cast("long")))
    good = (F.size(parts) == 4) & F.forall(parts, lambda x: F.coalesce(x <= 255, F.lit(False)))
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x))


def address_text(c: Column) -> Column:
    """The dotted address of a number; null beyond 0 .. 2**32 - 1."""
    parts = [F.shiftright(c.cast("long"), s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when((c >= 0) & (c < 2**32), F.concat_ws(".", *parts))


def range_lookup(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Left join of points with all ranges low .. high (inclusive) that hold them; the points' columns, then the ranges'.

    at, low and high are numbers of one kind.  Points are dealt by value to parts of about equal size
    (equal values to several, if there are many); a range goes to the parts that it touches, once to each.  A
    part is sorted by points and range starts and swept, with the ranges that are open in a heap:
    neither wide nor nested ranges cost more than the rows that they give.  A null point, or one that no
    range holds, has nulls; a range with a null end or low > high holds nothing.
    """
    spark = points.sparkSession
    whole = {dict(points.dtypes)[at], dict(ranges.dtypes)[low], dict(ranges.dtypes)[high]} <= {"tinyint", "smallint", "int", "bigint"}
    kind = "long" if whole else "double"
    p = points.select(F.struct("*").alias("p"), F.col(at).cast(kind).alias("v"))
    given = p.where("v IS NOT NULL")
    # The number beside a value cuts the rows of one value, if they are many.
    dealt = given.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(F.col("v"), F.xxhash64("n")).withColumn("part", F.spark_partition_id())
    placed = saved(dealt.select("part", "v", "p"), "points")
    edges = sorted((r.part, r.lo, r.hi) for r in placed.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect())  # one row a partition
    number, lows, highs = ([e[i] for e in edges] for i in range(3))
    sent = spark.sparkContext.broadcast((np.array(number, np.int32), np.array(lows), np.array(highs)))
    r = ranges.select(F.struct("*").alias("r"), F.col(low).cast(kind).alias("v"), F.col(high).cast(kind).alias("hi")).where("v <= hi")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lo, hi = sent.value
        for b in batches:
            # Parts are in the order of their values: those that a range touches lie side by side.
            first = np.searchsorted(hi, b.column("v").to_numpy(), "left")
            last = np.searchsorted(lo, b.column("hi").to_numpy(), "right")
            n = np.maximum(0, last - first)
            row = np.repeat(np.arange(len(n)), n)
            to = part[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            yield pa.RecordBatch.from_arrays([pa.array(to), *[c.take(pa.array(row)) for c in b.columns]], names=["part", "r", "v", "hi"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), *r.schema.fields])
    none = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    rows = r.mapInArrow(spread, schema).select("part", "v", F.lit(0).alias("point"), "hi", none(p, "p"), "r")
    rows = rows.unionByName(placed.select("part", "v", F.lit(1).alias("point"), none(r, "hi"), "p", none(r, "r")))
    swept = rows.repartition("part").sortWithinPartitions("part", "v", "point")
    found = swept.mapInArrow(_sweep, T.StructType([T.StructField(c, frame.schema[c].dataType) for frame, c in ((p, "p"), (r, "r"))]))
    return found.unionByName(p.where("v IS NULL").select("p", none(r, "r"))).select("p.*", "r.*")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, v, point, hi, p, r, sorted -> p, r of each point and each range that holds it; r null if none does."""
    key, pool, ends = None, None, []  # ends: a heap of (high, place in pool)
    for b in batches:
        part, point, v = b.column("part").to_numpy(), b.column("point").to_numpy(), b.column("v").to_pylist()
        hi, own, new = b.column("hi").to_pylist(), b.column("p"), b.column("r")
        # The open ranges come first in the pool, those of this batch behind them.
        order = [i for _, i in ends]
        kept = pool.take(pa.array(order, pa.int64())) if pool is not None else new.slice(0, 0)
        ends = [(h, i) for i, (h, _) in enumerate(ends)]
        heapq.heapify(ends)
        pool, shift = pa.concat_arrays([kept, new]), len(kept)
        left, right = [], []
        for i in range(b.num_rows):
            if part[i] != key:
                key, ends = part[i], []
            if not point[i]:
                heapq.heappush(ends, (hi[i], shift + i))
                continue
            while ends and ends[0][0] < v[i]:
                heapq.heappop(ends)
            left += [i] * max(1, len(ends))
            right += [e[1] for e in ends] or [None]
            if len(left) >= _AT_ONCE:
                yield pa.RecordBatch.from_arrays([own.take(pa.array(left)), pool.take(pa.array(right, pa.int64()))], names=["p", "r"])
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([own.take(pa.array(left)), pool.take(pa.array(right, pa.int64()))], names=["p", "r"])


def _running(steps: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """keys, _v, _side and the running sums of a key's steps up to each (_v, _side), itself included.

    steps: keys, _v, _side and sums.  Steps of one place become one row.  Spark deals the places to
    ranges of about equal size, each range adds up for itself, and what came before is added: a key may
    have any number of steps.  Sums are decimals, as a key's may be larger than any that is asked for.
    """
    places = steps.groupBy(*keys, "_v", "_side").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in sums])
    ranged = saved(places.repartitionByRange(*keys, "_v", "_side").withColumn("_range", F.spark_partition_id()), "steps")
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    before = here.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("_range").alias("_before"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_{c}") for c in sums])  # a key's ranges
    own = Window.partitionBy(*keys, "_range").orderBy("_v", "_side").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({c: F.sum(c).over(own) for c in sums})
    joined = summed.join(F.broadcast(before), [summed[c] == before[f"_{c}"] for c in keys] + [summed["_range"] == before["_before"]])
    return joined.select(*keys, "_v", "_side", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])


def totals_of_points(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, totals: dict[str, str]) -> DataFrame:
    """points with n, the number of ranges low .. high (inclusive) that hold them, and the totals of whole numbers of these: name -> column of ranges.

    Nothing is paired: what a point is given is the running sum of range starts up to it less that of
    ends before it.  0 where no range holds a point, or where it is null.
    """
    sums = ["n", *totals]
    points = saved(points, "points")  # read twice: what makes them is run once
    good = ranges.where(F.col(low) <= F.col(high))
    step = lambda v, side, sign: good.select(F.col(v).alias("_v"), F.lit(side).alias("_side"), F.lit(sign).alias("n"), *[(F.coalesce(c, F.lit(0)).cast("decimal(38,0)") * sign).alias(name) for name, c in totals.items()])
    asked = points.where(F.col(at).isNotNull()).select(F.col(at).alias("_v"), F.lit(1).alias("_side"), *[F.lit(0).alias(c) for c in sums]).distinct()
    told = _running(step(low, 0, 1).unionByName(asked).unionByName(step(high, 2, -1)), [], sums).where("_side = 1").drop("_side")
    return points.join(told, points[at] == told["_v"], "left").select(*[points[c] for c in points.columns], *[F.coalesce(told[c], F.lit(0)).cast("long").alias(c) for c in sums])


def totals_of_ranges(ranges: DataFrame, low: str, until: str, points: DataFrame, at: str, totals: dict[str, str], key: str) -> DataFrame:
    """ranges with n, the number of their key's points with low <= at, and at < until if there is one, and the totals of whole numbers of these: name -> column of points.

    Nothing is paired: a range is given the running sum of its key's points before its end less that before its start.
    """
    sums = ["n", *totals]
    said = points.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    said = said.select(key, F.col(at).alias("_v"), F.lit(1).alias("_side"), F.lit(1).alias("n"), *[F.coalesce(c, F.lit(0)).alias(name) for name, c in totals.items()])
    # One row a place and key, before it is read twice.
    said = said.groupBy(key, "_v", "_side").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in sums])
    edge = lambda v: ranges.where(F.col(v).isNotNull()).select(key, F.col(v).alias("_v"), F.lit(0).alias("_side"), *[F.lit(0).cast("decimal(38,0)").alias(c) for c in sums])
    told = _running(said.unionByName(edge(low).unionByName(edge(until)).where(F.col(key).isNotNull()).distinct()), [key], sums).where("_side = 0")
    part = lambda name, frame, *more: frame.select(F.col(key).alias(f"_{name}"), *more, *[F.col(c).alias(f"_{name}_{c}") for c in sums])
    first, last = part("first", told, F.col("_v").alias("_low")), part("last", told, F.col("_v").alias("_until"))
    whole = part("whole", said.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums]))
    held = ranges.join(first, (F.col(key) == F.col("_first")) & (F.col(low) == F.col("_low")), "left")
    held = held.join(last, (F.col(key) == F.col("_last")) & (F.col(until) == F.col("_until")), "left").join(whole, F.col(key) == F.col("_whole"), "left")
    some = F.col(until).isNull() | (F.col(low) < F.col(until))
    end = lambda c: F.when(F.col(until).isNull(), F.col(f"_whole_{c}")).otherwise(F.col(f"_last_{c}"))
    return held.select(*[ranges[c] for c in ranges.columns], *[F.coalesce(F.when(some, end(c) - F.col(f"_first_{c}")), F.lit(0)).cast("long").alias(c) for c in sums])
