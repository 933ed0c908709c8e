"""Event-stream state: sequences, replay, sessions, limits; batch forms and their Structured Streaming twins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

GAP_SECONDS = 1800


def micros(ts: str | F.Column) -> F.Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def ordered(key: str = "user_id") -> Window:
    return Window.partitionBy(key).orderBy("ts", "event_id")


def sequence(events: DataFrame, key: str = "user_id") -> DataFrame:
    """events with ``seq``, counted from 1 for each key."""
    return events.withColumn("seq", F.row_number().over(ordered(key)).cast("bigint"))


def replay(events: DataFrame, since: int, keep: int = 200, key: str = "user_id") -> DataFrame:
    """The last ``keep`` events of each key whose sequence number is above ``since``."""
    newest = Window.partitionBy(key).orderBy(F.desc("seq"))
    return sequence(events, key).withColumn("_age", F.row_number().over(newest)).where((F.col("_age") <= keep) & (F.col("seq") > since)).drop("_age")


def sessions(events: DataFrame, key: str = "user_id", gap: int = GAP_SECONDS) -> DataFrame:
    """events with ``session``: a new one starts after a pause of ``gap`` seconds or more."""
    w = ordered(key)
    pause = micros("ts") - micros(F.lag("ts").over(w))
    new = F.when(pause.isNull() | (pause >= gap * 1_000_000), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def missed(received: DataFrame, key: str = "user_id") -> DataFrame:
    """How many sequence numbers a subscriber missed before each event it received."""
    before = F.lag("seq").over(Window.partitionBy(key).orderBy("seq"))
    return received.withColumn("missed", F.coalesce(F.col("seq") - before - 1, F.lit(0)))


def sliding_load(events: DataFrame, seconds: int = 60, key: str = "user_id") -> DataFrame:
    """Requests and cost of each key within the last ``seconds`` before and at every event."""
    w = Window.partitionBy(key).orderBy(micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumns({"requests": F.count("*").over(w), "cost": F.sum("value").over(w)})


def tumbling_counts(events: DataFrame, seconds: int = 60, late: str | None = None) -> DataFrame:
    """Requests of each key and fixed window; ``late`` sets a watermark where events stream."""
    if late is not None:
        events = events.withWatermark("ts", late)
    return events.groupBy("user_id", F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n")


def size_limited(events: DataFrame, limit: int, size: F.Column, key: str = "user_id") -> DataFrame:
    """The leading events of each key whose sizes add up to ``limit`` at most."""
    used = F.sum(size).over(ordered(key).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("used", used).where(F.col("used") <= limit)


def latest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The type of each key's last event."""
    return events.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def stale_channels(channels: DataFrame, now: F.Column, idle: int = 300, age: int = 3600) -> DataFrame:
    """The channels (created, last_event, subscribers) older than ``age`` seconds, or without subscribers and idle for more than ``idle``."""
    passed = lambda since: micros(now) - micros(since)
    return channels.where((passed("created") > age * 1_000_000) | ((F.col("subscribers") == 0) & (passed("last_event") > idle * 1_000_000)))


class Breaker(NamedTuple):
    """When a service's circuit opens, in seconds and calls."""

    failures: int = 5
    successes: int = 3
    open_for: int = 30
    window: int = 60


class Circuit(NamedTuple):
    """What is known of one service: times in microseconds from 1970 on, -1 for none."""

    state: str = "closed"
    opened: int = -1
    since: int = -1
    failed: int = 0
    passed: int = 0


def call(circuit: Circuit, at: int, ok: bool, rule: Breaker) -> tuple[Circuit, bool]:
    """The circuit after a call, and whether the call was let through; a refused call has no outcome."""
    if circuit.state == "open" and at - circuit.opened >= rule.open_for * 1_000_000:
        circuit = circuit._replace(state="half_open", failed=0, passed=0)
    if circuit.state == "open":
        return circuit, False
    if circuit.state == "half_open":
        if not ok:
            return circuit._replace(state="open", opened=at, passed=0), True
        recovered = circuit.passed + 1 >= rule.successes
        return (Circuit() if recovered else circuit._replace(passed=circuit.passed + 1)), True
    if ok:
        return circuit._replace(failed=0, since=-1), True
    if circuit.since < 0 or at - circuit.since > rule.window * 1_000_000:
        circuit = circuit._replace(failed=0, since=at)
    circuit = circuit._replace(failed=circuit.failed + 1)
    return (circuit._replace(state="open", opened=at) if circuit.failed >= rule.failures else circuit), True


def circuit_states(calls: DataFrame, key: str, rule: Breaker = Breaker()) -> DataFrame:
    """key, event_id, state, allowed of every call (key, event_id, at in microseconds, ok), in the order of at and event_id.

    The state of a service depends on all its calls before, so these pass one
    task in their order, batch by batch; a task holds one batch and one state.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, circuit = None, Circuit()
        for frame in frames:
            states, allowed = [], []
            for name, at, ok in zip(frame[key], frame["at"], frame["ok"], strict=True):
                if name != service:
                    service, circuit = name, Circuit()
                circuit, let = call(circuit, at, ok, rule)
                states.append(circuit.state)
                allowed.append(let)
            yield pd.DataFrame({key: frame[key], "event_id": frame["event_id"], "state": states, "allowed": allowed})

    ordered_calls = calls.select(key, "event_id", "at", "ok").repartition(key).sortWithinPartitions(key, "at", "event_id")
    return ordered_calls.mapInPandas(run, f"{key} {calls.schema[key].dataType.simpleString()}, event_id bigint, state string, allowed boolean")


def stream_circuit_states(source: DataFrame, path: str, checkpoint: str, key: str, rule: Breaker = Breaker()):
    """Start a query that appends the state of each service after every call of ``source``, across micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(keys, frames, state: GroupState):
        circuit = Circuit(*state.get) if state.exists else Circuit()
        frame = pd.concat(frames).sort_values(["at", "event_id"])  # the calls of one micro-batch
        out = []
        for event_id, at, ok in zip(frame["event_id"], frame["at"], frame["ok"], strict=True):
            circuit, let = call(circuit, at, ok, rule)
            out.append((keys[0], event_id, circuit.state, let))
        state.update(tuple(circuit))
        yield pd.DataFrame(out, columns=[key, "event_id", "state", "allowed"])

    schema = f"{key} {source.schema[key].dataType.simpleString()}, event_id bigint, state string, allowed boolean"
    found = source.groupBy(key).applyInPandasWithState(run, schema, "state string, opened bigint, since bigint, failed int, passed int", "append", GroupStateTimeout.NoTimeout)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_tumbling_counts(source: DataFrame, path: str, checkpoint: str, seconds: int = 60, late: str = "10 minutes"):
    """Start a query that appends finished windows of ``source``, a streaming DataFrame of events, to Parquet at ``path``."""
    out = tumbling_counts(source, seconds, late)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_sequence(source: DataFrame, path: str, checkpoint: str, key: str = "user_id"):
    """Start a query that numbers the events of each key across micro-batches, in order of arrival and time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def number(keys, frames, state: GroupState):
        last = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            seq = range(last + 1, last + 1 + len(frame))
            last += len(frame)
            yield pd.DataFrame({key: frame[key], "event_id": frame["event_id"], "seq": seq})
        state.update((last,))

    numbered = source.groupBy(key).applyInPandasWithState(number, f"{key} bigint, event_id bigint, seq bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
    return numbered.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
