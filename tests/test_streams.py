"""Streams over several batches against their tables, and ingestion with bad rows."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chat
from tidemark.streaming import ordered, stateful

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def steps(automaton, rows):
    """rows: (key, id, seconds, *values)."""
    states, out = {}, {}
    for k, i, s, *values in sorted(rows, key=lambda r: (r[2], r[1])):
        state, told = automaton.step(states.get(k, automaton.empty), int(s * 1_000_000), *values)
        states[k], out[i] = state, told
    return out


def streamed(spark, folder, df, parts, make, flush):
    """make(stream)'s rows; df's rows come in several batches, and flush moves the watermark past all of them."""
    batches = df.randomSplit([1.0] * parts, 7)
    for n, b in enumerate([*batches, flush, flush]):
        b.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = stateful.parquet_stream(spark, f"{folder}/in", df.schema, 1)
        q = make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    return spark.read.parquet(f"{folder}/out")


def test_breaker_edges():
    b = ordered.Breaker("failed", 2, 30)
    rows = [("k", i, s, f) for i, (s, f) in enumerate([(0, True), (1, True), (31, False), (31.000001, True), (40, False), (61.5, False), (62, True)])]
    assert [x[0] for x in steps(b, rows).values()] == [True, True, False, True, False, True, True]


def test_sliding_limit_edges():
    a = ordered.SlidingLimit("limit", "seconds")
    rows = [("k", i, s, limit, 10) for i, (s, limit) in enumerate([(0, 2), (5, 2), (9, 2), (10, 2), (14.9, 2), (15, 2), (15, 3), (15, 3), (16, 3), (17, 3)])]
    assert [x[0] for x in steps(a, rows).values()] == [True, True, False, True, False, True, True, True, True, False]


def test_one_time_keys_are_freed_by_failures():
    rows = [("k", i, s, f) for i, (s, f) in enumerate([(0, True), (0, False), (5, True), (10, True), (10, False)])]
    assert [x[0] for x in steps(ordered.OneTime(10, "failed"), rows).values()] == [True, True, False, True, True]


@pytest.fixture(scope="module")
def calls():
    r = random.Random(4)
    return [(r.choice(["a", "b", None]), i, r.randrange(600), r.random() < 0.6, r.choice([2, 2, 2, 3]), 60) for i in range(300)]


def frame(spark, calls):
    return spark.createDataFrame([(k, i, at(s), f, n, w) for k, i, s, f, n, w in calls], "k string, id long, ts timestamp, failed boolean, limit int, seconds int")


AUTOMATA = [(ordered.Breaker("failed", 2, 30), lambda c: (c[3],)), (ordered.SlidingLimit("limit", "seconds"), lambda c: c[4:]), (ordered.OneTime(45, "failed"), lambda c: (c[3],))]


@pytest.mark.parametrize("n", range(3))
def test_decided_is_the_automaton(spark, calls, n):
    automaton, values = AUTOMATA[n]
    df = ordered.decided(frame(spark, calls).unionByName(frame(spark, calls[:1]).withColumns({"ts": F.lit(None).cast("timestamp"), "id": F.lit(9999).cast("long")})), ["k"], "ts", "id", automaton)
    got = {r.id: tuple(r)[2:] for r in df.collect()}
    assert got == steps(automaton, [(c[0], c[1], c[2], *values(c)) for c in calls])
    assert len({v for v in got.values()}) == 2


def test_a_hot_key_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        r = random.Random(1)
        calls = [("hot" if r.random() < 0.9 else "other", i, i // 3, r.random() < 0.4, 5, 20) for i in range(3000)]
        got = {x.id: x.passed for x in ordered.decided(frame(spark, calls), ["k"], "ts", "id", ordered.Breaker("failed", 3, 20)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: v[0] for i, v in steps(ordered.Breaker("failed", 3, 20), [c[:4] for c in calls]).items()}


def test_breaker_stream_is_the_table(spark, tmp_path, calls):
    df = frame(spark, [c for c in calls if c[0]])
    breaker = ordered.Breaker("failed", 2, 30)
    flush = frame(spark, [("flush", -1, 100_000, False, 2, 60)])
    got = streamed(spark, str(tmp_path), df, 3, lambda s: ordered.decided_stream(s, ["k"], "ts", "id", breaker, "1 hour"), flush)
    assert {r.id: r.passed for r in got.where("k <> 'flush'").collect()} == {r.id: r.passed for r in ordered.decided(df, ["k"], "ts", "id", breaker).collect()}


def test_conversation_stream_is_route_messages(spark, tmp_path):
    r = random.Random(9)
    rows = [(c, 100 * c + t, at(c + 10 * t), t == 5 and c % 2 == 0, r.random() < 0.1, r.random() < 0.2, r.random() < 0.5) for c in range(12) for t in range(9)]
    df = spark.createDataFrame(rows, "conv long, id long, ts timestamp, closes boolean, manual boolean, missing boolean, good boolean")
    routes = ordered.Conversation("closes", "manual", "missing", "good")
    flush = spark.createDataFrame([(-1, -1, at(100_000), False, False, False, False)], df.schema)
    got = streamed(spark, str(tmp_path), df, 2, lambda s: ordered.decided_stream(s, ["conv"], "ts", "id", routes, "1 hour"), flush)
    want = chat.route_messages(df, "conv", "ts", F.col("closes"), F.col("manual"), F.col("missing"), F.col("good"))
    told = lambda d: {x.id: (x.stored, x.route, x.transferred) for x in d.collect()}
    assert told(got.where("conv >= 0")) == told(want) == told(ordered.decided(df, ["conv"], "ts", "id", routes))


def test_redelivery_by_timer(spark, tmp_path):
    sent = [(i, at(7 * i)) for i in range(20)]
    acked = [(i, at(7 * i + d)) for i, d in enumerate([10, 60, 61, 119, 120, 121, 500]) for _ in range(1)]
    kind = "message_id long, ts timestamp, ack boolean"
    df = spark.createDataFrame([(*x, False) for x in sent] + [(*x, True) for x in acked], kind)
    flush = spark.createDataFrame([(-1, at(100_000), True)], kind)

    def make(s):
        d = s.where("NOT ack").select("message_id", F.col("ts").alias("delivered_at"))
        a = s.where("ack").select("message_id", F.col("ts").alias("acked_at"))
        return ordered.redelivery_stream(d, a, "1 hour", 60, 2)

    got = streamed(spark, str(tmp_path), df, 2, make, flush)
    want = ordered.redeliveries(spark.createDataFrame(sent, "message_id long, delivered_at timestamp"), spark.createDataFrame(acked, "message_id long, acked_at timestamp"), F.lit(at(90_000)), 60, 2)
    told = lambda d: sorted((x.message_id, x.attempt, x["at"]) for x in d.collect())
    assert told(got) == told(want) and {x[0] for x in told(want) if x[1] == 1} == set(range(20)) - {0, 1}


def test_one_bad_row_of_a_thousand(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") == 7).alias("rejected")).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = stateful.parquet_stream(spark, f"{tmp_path}/in", "id long, rejected boolean")
    process = lambda b: b.withColumn("half", F.when(F.col("id") == 613, F.raise_error(F.lit("cannot parse this"))).otherwise(F.col("id") / 2))
    for _ in range(2):  # and the same after a restart
        q = stateful.ingest(stream, process, f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/c", F.col("rejected"), 3, 0.01)
        q.awaitTermination(300)
        assert q.exception() is None
        good, dead = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/dead")
        assert sorted(r.id for r in good.collect()) == [i for i in range(1000) if i not in (7, 613)]
        assert sorted((r.id, r.attempts, "cannot parse this" in r.error) for r in dead.collect()) == [(7, 1, False), (613, 3, True)]
    assert not glob.glob(f"{tmp_path}/c/isolation/*")


def test_ingestion_stops_when_everything_fails_and_goes_on(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/in")
    stream = stateful.parquet_stream(spark, f"{tmp_path}/in", "id long")
    run = lambda process: stateful.ingest(stream, process, f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/c", F.lit(False), 1, 0, 2)
    with pytest.raises(Exception, match="rows of batch 0 fail"):
        run(lambda b: b.select(F.raise_error(F.lit("down")).cast("long").alias("id"))).awaitTermination(120)
    run(lambda b: b).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/good").count() == 20 and spark.read.parquet(f"{tmp_path}/dead").count() == 0
