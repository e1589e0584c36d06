"""Decisions that depend on what was decided before: breakers, sliding limits, one-time keys, conversations, redelivery.

An ``Automaton`` looks at one row after the other, in the order of time, and keeps a small state for
each key.  ``decided`` runs it over a table: partitions are sorted by key and time and read as a stream, so a
key may have any number of rows.  ``decided_stream`` runs it over a stream: rows wait in keyed state
until the watermark has passed them, a timer takes them out in order, and a state that has
run out is dropped; so the decisions are those of the table, however the stream is cut into batches.
Rows that come later than the watermark allows are lost.  The session needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

SECOND = 1_000_000  # times are microseconds


class Automaton:
    """inputs: the columns that a step looks at; state and output: their types; empty: the state of an unknown key."""

    inputs: list[str]
    state: str
    output: str
    empty: tuple

    def step(self, state: tuple, at: int, *values) -> tuple[tuple, tuple]:
        """The state after a row and what is told of the row."""
        raise NotImplementedError

    def ends(self, state: tuple) -> int | None:
        """From when on the state is as good as empty; None: never."""
        return None


@dataclass
class Breaker(Automaton):
    """After ``threshold`` failures in a row calls are rejected for ``open_seconds``, the last moment included.

    Then calls pass until one succeeds, which closes it, or fails, which opens it anew.  A rejected
    call changes nothing.
    """

    failed: str
    threshold: int = 5
    open_seconds: float = 30.0
    state: str = "failures int, opened long"
    output: str = "passed boolean"
    empty: tuple = (0, 0)

    def __post_init__(self):
        self.inputs = [self.failed]

    def step(self, state, at, failed):
        failures, opened = state
        if failures >= self.threshold and at - opened <= self.open_seconds * SECOND:
            return state, (False,)
        if not failed:
            return self.empty, (True,)
        return (failures + 1, at if failures + 1 >= self.threshold else 0), (True,)


@dataclass
class SlidingLimit(Automaton):
    """At most ``limit`` calls in any interval; a key whose limit or interval differs from that of its last call starts anew.

    limit and seconds are columns, so that each row brings the setting of its time.
    """

    limit: str
    seconds: str
    state: str = "max int, span long, taken array<long>"
    output: str = "allowed boolean"
    empty: tuple = (0, 0, [])

    def __post_init__(self):
        self.inputs = [self.limit, self.seconds]

    def step(self, state, at, limit, seconds):
        span = int(seconds * SECOND)
        taken = [t for t in state[2] if at - t < span] if (state[0], state[1]) == (limit, span) else []
        if len(taken) >= limit:
            return (limit, span, taken), (False,)
        return (limit, span, [*taken, at]), (True,)

    def ends(self, state):
        return (state[2][-1] if state[2] else 0) + state[1]


@dataclass
class OneTime(Automaton):
    """A key is taken for ``seconds`` by the first call; one that failed (a column, if given) frees it at once."""

    seconds: float
    failed: str | None = None
    state: str = "until long"
    output: str = "accepted boolean"
    empty: tuple = field(default=(-(2**63),))

    def __post_init__(self):
        self.inputs = [self.failed] if self.failed else []

    def step(self, state, at, failed=False):
        if at < state[0]:
            return state, (False,)
        return ((at if failed else at + int(self.seconds * SECOND)),), (True,)

    def ends(self, state):
        return state[0]


@dataclass
class Conversation(Automaton):
    """Routes of messages (``route_messages``): what closes a conversation is answered, what follows is ignored; a transfer is remembered."""

    closes: str
    manual: str
    missing_slots: str
    answerable: str
    state: str = "closed boolean, transferred boolean"
    output: str = "stored boolean, route string, transferred boolean"
    empty: tuple = (False, False)

    def __post_init__(self):
        self.inputs = [self.closes, self.manual, self.missing_slots, self.answerable]

    def step(self, state, at, closes, manual, missing_slots, answerable):
        closed, transferred = state
        route = "IGNORED" if closed else "TRANSFER" if manual else "CLARIFY" if missing_slots else "ANSWER" if answerable else "TRANSFER"
        return (closed or bool(closes), transferred or route == "TRANSFER"), (not closed, route, transferred)


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _output(automaton: Automaton) -> T.StructType:
    return T._parse_datatype_string(automaton.output)


def decided(rows: DataFrame, key: list[str], time_col: str, id_col: str, automaton: Automaton) -> DataFrame:
    """key, id and the automaton's output of each row with a time; rows of one time go by id.  A null key is a key of its own."""
    columns = [*key, id_col]
    taken = rows.where(F.col(time_col).isNotNull()).select(*columns, _micros(time_col).alias("_at"), *[F.col(c).alias(f"_in{i}") for i, c in enumerate(automaton.inputs)])
    dealt = taken.withColumn("_key", F.xxhash64(*key)).repartition("_key").sortWithinPartitions("_key", *key, "_at", id_col)
    output = _output(automaton)
    n_in = len(automaton.inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, automaton.empty
        for b in batches:
            if not b.num_rows:
                continue
            names = b.select(key).to_struct_array()
            hashes = b.column("_key").to_numpy()
            at = b.column("_at").to_pylist()
            values = [b.column(f"_in{i}").to_pylist() for i in range(n_in)]
            edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))  # two keys of one hash are told apart to 2**-64
            told = []
            starts = set(edges.tolist())
            for i in range(b.num_rows):
                if i in starts:
                    name = (int(hashes[i]), names[i].as_py())
                    if name != held:
                        held, state = name, automaton.empty
                state, out = automaton.step(state, at[i], *[v[i] for v in values])
                told.append(out)
            outs = [pa.array([t[j] for t in told], b_type) for j, b_type in enumerate(_arrow(output))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], *outs], names=[*columns, *output.names])

    schema = T.StructType([*[rows.schema[c] for c in columns], *output.fields])
    return dealt.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    return [kinds[f.dataType.simpleString()] for f in schema.fields]


class _InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, and steps through them in order."""

    def __init__(self, automaton: Automaton, id_col: str, id_type: str, inputs: T.StructType, key: list[str]):
        self.automaton, self.id_col, self.key = automaton, id_col, key
        self.waiting_schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("id", T._parse_datatype_string(id_type)), *inputs.fields])
        self.known_schema = T._parse_datatype_string(automaton.state)  # here, as init runs without a session
        self.names = _output(automaton).names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.known = handle.getValueState("known", self.known_schema)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:  # one frame after the other: what waits is kept in the state store
            held = list(zip(*[frame[c].tolist() for c in ["at_us", self.id_col, *[f"in{i}" for i in range(len(self.waiting_schema) - 2)]]], strict=True))
            if held:
                self.waiting.appendList(held)
                least = min(h[0] for h in held)
                earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            self._wake(earliest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for r in self.waiting.get():
            (due if r[0] < passed else later).append(tuple(r))
        state = tuple(self.known.get()) if self.known.exists() else self.automaton.empty
        told = []
        for at, name, *values in sorted(due, key=lambda r: (r[0], r[1])):
            state, out = self.automaton.step(state, at, *values)
            told.append((*key, name, *out))
        ends = self.automaton.ends(state)
        if ends is not None and ends <= passed:
            self.known.clear()  # nothing that may still come can tell the difference
        elif due:
            self.known.update(state)
        if later:
            self.waiting.put(later)
            self._wake(min(r[0] for r in later))
        else:
            self.waiting.clear()
            if ends is not None and ends > passed:
                self._wake(ends)
        if told:
            yield pd.DataFrame(told, columns=[*self.key, self.id_col, *self.names])

    def close(self) -> None:
        pass


def decided_stream(stream: DataFrame, key: list[str], time_col: str, id_col: str, automaton: Automaton, delay: str) -> DataFrame:
    """What ``decided`` tells, of a stream whose rows come at most ``delay`` late."""
    taken = stream.withWatermark(time_col, delay).where(F.col(time_col).isNotNull())
    # Names that begin with _ don't reach the processor.
    taken = taken.select(*key, id_col, time_col, _micros(time_col).alias("at_us"), *[F.col(c).alias(f"in{i}") for i, c in enumerate(automaton.inputs)])
    inputs = T.StructType([taken.schema[f"in{i}"] for i in range(len(automaton.inputs))])
    schema = T.StructType([*[taken.schema[c] for c in [*key, id_col]], *_output(automaton).fields])
    processor = _InOrder(automaton, id_col, dict(taken.dtypes)[id_col], inputs, key)
    return taken.groupBy(*key).transformWithStateInPandas(processor, schema, "append", "EventTime")


# Redelivery


def redeliveries(deliveries: DataFrame, acks: DataFrame, until: Column | None, idle_seconds: int = 300, most: int = 3, now: DataFrame | None = None) -> DataFrame:
    """message_id, attempt, at: what is delivered again by ``until`` (or by the time in the one row of now): every idle_seconds after a delivery without an acknowledgement, ``most`` times.

    deliveries: message_id, delivered_at (the first counts); acks: message_id, acked_at (the first
    counts; one in the moment of the redelivery is in time).
    """
    first = deliveries.groupBy("message_id").agg(F.min(_micros("delivered_at")).alias("sent")).join(acks.groupBy("message_id").agg(F.min(_micros("acked_at")).alias("acked")), "message_id", "left")
    again = first.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("at", F.col("sent") + F.col("attempt") * idle_seconds * SECOND)
    if now is not None:
        again = again.crossJoin(F.broadcast(now.select(_micros("now").alias("_now"))))  # one row
    limit = F.unix_micros(until.cast("timestamp")) if now is None else F.col("_now")
    due = again.where((F.col("acked").isNull() | (F.col("acked") > F.col("at"))) & (F.col("at") <= limit))
    return due.select("message_id", "attempt", F.timestamp_micros("at").alias("at"))


class _Redelivery(StatefulProcessor):
    """A timer for each open delivery; an acknowledgement is kept until the timer that it answers."""

    def __init__(self, idle_ms: int, most: int):
        self.idle, self.most = idle_ms, most
        self.schema = T._parse_datatype_string("sent long, attempts int, acked long")

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        sent, attempts, acked = tuple(self.open.get()) if self.open.exists() else (None, 0, None)
        for frame in rows:
            for at, is_ack in zip(frame["at_us"].tolist(), frame["is_ack"].tolist(), strict=True):
                if is_ack:
                    acked = at if acked is None else min(acked, at)
                elif attempts == 0:
                    sent = at if sent is None else min(sent, at)
        self.open.update((sent, attempts, acked))
        if sent is not None and attempts == 0:
            self._wake(sent)
        return iter([])

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-(at + self.idle * 1000) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.open.exists():
            return
        sent, attempts, acked = tuple(self.open.get())
        due = sent + (attempts + 1) * self.idle * 1000
        if due > timerValues.getCurrentWatermarkInMs() * 1000:
            return  # a timer of a delivery that an earlier one has replaced
        if acked is not None and acked <= due:
            self.open.clear()
            return
        attempts += 1
        if attempts < self.most:
            self.open.update((sent, attempts, acked))
            self._wake(sent + attempts * self.idle * 1000)
        else:
            self.open.clear()
        yield pd.DataFrame({"message_id": [key[0]], "attempt": [attempts], "at": [pd.Timestamp(due, unit="us")]}).astype({"attempt": "int32"})

    def close(self) -> None:
        pass


def redelivery_stream(deliveries: DataFrame, acks: DataFrame, delay: str, idle_seconds: int = 300, most: int = 3) -> DataFrame:
    """``redeliveries`` of streams: each comes when the watermark passes its time."""
    kind = dict(deliveries.dtypes)["message_id"]
    sent = deliveries.select("message_id", F.col("delivered_at").alias("time"), F.lit(False).alias("is_ack"))
    told = acks.select("message_id", F.col("acked_at").alias("time"), F.lit(True).alias("is_ack"))
    rows = sent.unionByName(told).withWatermark("time", delay).withColumn("at_us", _micros("time"))
    return rows.groupBy("message_id").transformWithStateInPandas(_Redelivery(idle_seconds * 1000, most), f"message_id {kind}, attempt int, at timestamp", "append", "EventTime")


# Signed calls


def verified(calls: DataFrame, secrets: DataFrame, now: str, timeout_seconds: int = 600) -> DataFrame:
    """call_id and verdict (ok, headers, late, app, signature, replay) of calls(call_id, app_id, timestamp, nonce, sign, params, body, headers, now).

    As ``signature`` and ``signature_fresh`` say; a nonce of an app counts once in twice the timeout,
    from the first call whose signature is right.  secrets: app_id, secret.
    """
    from tidemark.functions.codecs import told_map

    known = calls.join(secrets.select("app_id", F.col("secret").alias("_secret")), "app_id", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    sign = F.sha2(F.concat(told_map(F.col("params")), F.coalesce("body", F.lit("")), told_map(F.col("headers")), F.coalesce("_secret", F.lit(""))), 256)
    late = F.abs(_micros(now) - _micros("timestamp")) > timeout_seconds * SECOND
    checked = F.when(blank("app_id") | F.col("timestamp").isNull() | (F.char_length(F.coalesce("nonce", F.lit(""))) < 10) | blank("sign"), "headers").when(late, "late").when(F.col("_secret").isNull(), "app").when(F.col("sign") != sign, "signature")
    marked = known.select("call_id", "app_id", "nonce", F.col(now).alias("_now"), checked.alias("_bad"))
    good = decided(marked.where("_bad IS NULL"), ["app_id", "nonce"], "_now", "call_id", OneTime(2 * timeout_seconds))
    return marked.where("_bad IS NOT NULL").select("call_id", F.col("_bad").alias("verdict")).unionByName(good.select("call_id", F.when(F.col("accepted"), "ok").otherwise("replay").alias("verdict")))
