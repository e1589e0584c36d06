"""Streams: ingestion with retries and a dead-letter sink, idempotency, rate limits, delivery, trimming.

Decisions that depend on earlier ones are in ``ordered``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


def parquet_stream(spark, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest(stream: DataFrame, process: Callable[[DataFrame], DataFrame], good_path: str, dead_path: str, checkpoint: str, failed: Column, attempts: int = 3, wait_seconds: float = 1.0, most_dead: int = 10_000) -> StreamingQuery:
    """At-least-once ingestion that sets single bad rows apart; dead letters have the columns attempts and error.

    Rows that ``failed`` tells are dead letters at once.  A batch whose processing raises is tried
    ``attempts`` times, with a growing wait; then it is cut into halves by a hash of its rows' numbers,
    and halves that fail again, until the bad rows are alone: about 2 log2 n runs for each.  A row that
    fails alone is tried ``attempts`` times and becomes a dead letter.  More than ``most_dead`` such rows in
    a batch mean that not the rows are at fault: the stream stops, and goes on with the batch when it
    is started again.  A batch's files are written when all its rows are settled, and overwritten if the batch is
    run again, so the sinks hold each row once; process itself may see a row several times.
    """

    def tried(rows: DataFrame, path: str, times: int) -> Exception | None:
        for attempt in range(1, times + 1):
            try:
                process(rows).write.mode("overwrite").parquet(path)
                return None
            except Exception as e:
                if attempt == times:
                    return e
                time.sleep(wait_seconds * attempt)

    def sink(batch: DataFrame, number: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        work = f"{checkpoint}/isolation/batch={number}"
        # Rows are numbered once, in a table, so that every half is the same rows whenever it is read.
        numbered = batch.select(F.struct(*columns).alias("row"), F.coalesce(failed, F.lit(False)).alias("failed"), F.monotonically_increasing_id().alias("n"))
        numbered.withColumn("spot", F.xxhash64("n")).write.mode("overwrite").parquet(f"{work}/rows")
        rows = spark.read.schema(T.StructType([*numbered.schema.fields, T.StructField("spot", T.LongType())])).parquet(f"{work}/rows")
        good = rows.where("NOT failed")
        dead = [rows.where("failed").select("row.*", F.lit(1).alias("attempts"), F.lit("rejected").alias("error"))]
        if tried(good.select("row.*"), f"{good_path}/batch={number}", attempts) is not None:
            pieces, alone, open_ = [], 0, [(-(2**63), 2**63 - 1)]
            while open_:
                lo, hi = open_.pop()
                part = good.where(F.col("spot").between(lo, hi))
                some = part.limit(2).count()
                if not some:
                    continue
                path = f"{work}/piece={len(pieces)}"
                error = tried(part.select("row.*"), path, 1 if some > 1 else attempts)
                if error is None:
                    pieces.append(path)
                elif some > 1:
                    middle = (lo + hi) // 2
                    open_ += [(middle + 1, hi), (lo, middle)]
                else:
                    alone += 1
                    if alone > most_dead:
                        raise RuntimeError(f"more than {most_dead} rows of batch {number} fail") from error
                    told = str(error).strip().splitlines() or [type(error).__name__]
                    dead.append(part.select("row.*", F.lit(attempts).alias("attempts"), F.lit(told[0][:500]).alias("error")))
            if pieces:
                spark.read.parquet(*pieces).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        lost = dead[0]
        for more in dead[1:]:
            lost = lost.unionByName(more)
        lost.write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(work)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotent(stream: DataFrame, key: list[str], time_col: str, ttl: str) -> DataFrame:
    """The first event of each key inside the time to live."""
    return stream.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(key)


def idempotent_batch(events: DataFrame, key: list[str], time_col: str, order: str, ttl_seconds: int) -> DataFrame:
    """key and order of the events that a key with this time to live accepts: those at least the ttl after the last accepted one.

    What is accepted depends on what was before: a partition is sorted by key and time and read as a
    stream that holds one time only, so a key may have any number of events.  Events without a time
    are not accepted.
    """
    rows = events.where(F.col(time_col).isNotNull()).select(*key, F.col(order), F.unix_micros(F.col(time_col).cast("timestamp")).alias("_at"))
    rows = rows.select(F.xxhash64(*key).alias("_key"), "*")
    dealt = rows.repartition("_key", *key).sortWithinPartitions("_key", *key, "_at", order)
    ttl, columns = ttl_seconds * 1_000_000, [*key, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, 0
        for b in batches:
            at = b.column("_at").to_numpy()
            names = b.select(["_key", *key]).to_struct_array()
            hashes = b.column("_key").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(hashes)) + 1).tolist(), len(at)]
            taken = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                name = names[lo].as_py()
                i = lo if name != held else lo + int(np.searchsorted(at[lo:hi], last + ttl))
                held = name
                while i < hi:
                    taken.append(i)
                    last = int(at[i])
                    i = max(i + 1, i + int(np.searchsorted(at[i:hi], last + ttl)))
            yield b.select(columns).take(pa.array(taken, pa.int64()))

    return dealt.mapInArrow(run, T.StructType([rows.schema[c] for c in columns]))


def rate_limited(events: DataFrame, key: list[str], time_col: str, order: str, limit: int, interval: str) -> DataFrame:
    """Events with allowed: whether they are among the first ``limit`` of their key and interval."""
    w = Window.partitionBy(*key, F.window(time_col, interval)).orderBy(time_col, order)
    return events.withColumn("allowed", F.row_number().over(w) <= limit)


def rate_windows(events: DataFrame, key: list[str], time_col: str, limit: int, interval: str, watermark: str | None = None) -> DataFrame:
    """Windows in which a key goes beyond its limit; on a stream with a watermark."""
    source = events.withWatermark(time_col, watermark) if watermark else events
    w = F.window(time_col, interval)
    return source.groupBy(*key, w.alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(*key, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: list[str], time_col: str, gap: str, watermark: str | None = None) -> DataFrame:
    """An extension: sessions that end after a gap."""
    source = events.withWatermark(time_col, watermark) if watermark else events
    s = F.session_window(time_col, gap)
    return source.groupBy(*key, s.alias("s")).agg(F.count("*").alias("n")).select(*key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def failure_runs(calls: DataFrame, key: list[str], order: list[Column], failed: Column, least: int = 5) -> DataFrame:
    """Runs of at least so many failures in a row: what opens a breaker, in a batch."""
    from tidemark.operators.windows import runs

    return runs(calls, key, order, failed).where(F.col("n") >= least)


def pending(deliveries: DataFrame, acks: DataFrame, now: Column, idle: str = "INTERVAL 5 MINUTES") -> DataFrame:
    """Messages to deliver again: delivered, never acknowledged, and idle long enough since the last delivery."""
    last = deliveries.groupBy("message_id").agg(F.max("delivered_at").alias("delivered_at"), F.count("*").alias("deliveries"))
    return last.join(acks.select("message_id"), "message_id", "left_anti").where(F.col("delivered_at") <= now - F.expr(idle))


def published(messages: DataFrame, subscriptions: DataFrame, channel: str, at: str) -> DataFrame:
    """messages with subscriber: each goes to everyone who listens to its channel at its time (since <= at, and at < until if there is one).

    What is published while nobody listens is lost.  subscriptions: channel, subscriber, since, until.
    A stream of messages joins a table of subscriptions alike.
    """
    told = subscriptions.select(F.col("channel").alias("_channel"), "subscriber", "since", "until")
    joined = messages.join(told, messages[channel] == told["_channel"])
    return joined.where((F.col("since") <= F.col(at)) & (F.col("until").isNull() | (F.col(at) < F.col("until")))).drop("_channel", "since", "until")


def delivered(messages: DataFrame, subscriptions: DataFrame, channel: str, at: str, totals: dict[str, str]) -> DataFrame:
    """subscriptions with n, how many messages ``published`` gives them, and totals of the messages' whole numbers (name -> column), without a row per delivery."""
    from tidemark.operators.ranges import totals_of_ranges

    return totals_of_ranges(subscriptions, "since", "until", messages.withColumnRenamed(channel, "channel"), at, totals, "channel")


def consumer_group(messages: DataFrame, acks: DataFrame, stream: str, number: str, members: int, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(open, dead): what a group's members have still to work on, each message at one member, and what failed too often.

    A message is done once an attempt succeeded: acks(message, succeeded) has a row per attempt.  A
    member is chosen by the message's hash, so a message that comes again comes to the same one.
    """
    told = acks.groupBy(F.col(number)).agg(F.max(F.col("succeeded").cast("int")).alias("_done"), F.count("*").alias("attempts"))
    state = messages.join(told, number, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).where(F.coalesce("_done", F.lit(0)) == 0).drop("_done")
    member = F.pmod(F.xxhash64(stream, number), F.lit(members)).cast("int")
    return state.where(F.col("attempts") < attempts).withColumn("member", member), state.where(F.col("attempts") >= attempts)


def trim(messages: DataFrame, stream_col: str, order: str, keep: int = 10_000, parts: int = 64) -> DataFrame:
    """The latest ``keep`` messages of each stream.

    A stream's messages are cut by hash into parts, whose latest meet in one: a stream may have any
    share of the messages.
    """
    n = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy(F.desc(order)))
    some = messages.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts))).withColumn("_n", n(stream_col, "_part")).where(F.col("_n") <= keep).drop("_part", "_n")
    return some.withColumn("_n", n(stream_col)).where(F.col("_n") <= keep).drop("_n")
