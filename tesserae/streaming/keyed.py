"""Operators with state of their own a key: events are put in order behind the watermark, then pass a small state machine.

What the watermark has passed can't change any more, as later arrivals of that time are late and dropped. So the results don't depend
on how events are dealt to micro-batches, and equal those of the batch operators on the same events, up to what is still open at the end.
State is kept in RocksDB: `with_state` sets the provider for the time that a stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tesserae.session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: An event as it waits; waiting events are kept in packed chunks of at most CHUNK, so the store sees a few values a key and not a row an event.
EVENT = np.dtype([("ts", "<i8"), ("id", "<i8"), ("value", "<f8"), ("opens", "?")])
CHUNK = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def chunks(events: np.ndarray) -> Iterator[tuple[bytes]]:
    """Packed events, a tuple a chunk, as the list state takes them."""
    return ((events[i : i + CHUNK].tobytes(),) for i in range(0, len(events), CHUNK))


class InOrder(StatefulProcessor):
    """Events of a key (ts in microseconds, id, value, opens) step by step in the order of (ts, id), once the watermark has passed them."""

    memory: str
    columns: list[str]

    def fresh(self) -> tuple:
        raise NotImplementedError

    def step(self, memory: tuple, event: tuple) -> tuple[tuple, list[tuple]]:
        """The memory after an event, and what it gives out."""
        raise NotImplementedError

    def settle(self, memory: tuple, now: int) -> tuple[tuple, list[tuple]]:
        """What the passing of time alone gives out."""
        return memory, []

    def due(self, memory: tuple) -> int | None:
        """When time alone will next give something out."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "chunk binary")
        self.state = handle.getValueState("memory", self.memory)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for df in rows:
            new = np.empty(len(df), EVENT)
            for field, column in zip(EVENT.names, ("micros", "id", "value", "opens"), strict=True):
                new[field] = df[column].to_numpy()
            for chunk in chunks(new):
                self.pending.appendValue(chunk)
            first += [int(new["ts"].min())] if len(new) else []
        if first:
            self.wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [np.frombuffer(bytes(c[0]), EVENT) for c in self.pending.get()]
        waiting = np.concatenate(parts) if parts else np.empty(0, EVENT)
        waiting = waiting[np.lexsort([waiting[c] for c in reversed(EVENT.names)])]
        known = self.state.get()
        memory, out = tuple(known) if known is not None else self.fresh(), []
        ready = waiting[: np.searchsorted(waiting["ts"], now, side="right")]
        for event in ready.tolist():
            memory, given = self.step(memory, event)
            out += given
        memory, given = self.settle(memory, now)
        out += given
        if len(ready):
            left = waiting[len(ready) :]
            self.pending.put(list(chunks(left))) if len(left) else self.pending.clear()
        self.state.update(memory)
        times = [int(waiting["ts"][len(ready)])] if len(ready) < len(waiting) else []
        times += [t for t in [self.due(memory)] if t is not None]
        if times:
            self.wake(min(times))
        if out:
            columns = dict(zip(self.columns, zip(*out, strict=True), strict=True))
            timed = {c: np.array(v, "datetime64[us]") if c.endswith("_ts") or c == "ts" else v for c, v in columns.items()}
            yield pd.DataFrame({"key": [key[0]] * len(out)} | timed)

    def wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


class Flush(InOrder):
    """Batches of a client: full ones at once, others when nothing has come for the gap."""

    memory = "batch long, n int, first_ts long, last_ts long"
    columns = ["batch", "n", "first_ts", "last_ts", "why"]

    def __init__(self, most: int, gap: int):
        self.most, self.gap = most, gap

    def fresh(self) -> tuple:
        return 1, 0, 0, 0

    def step(self, memory, event):
        memory, out = self.settle(memory, event[0])
        batch, n, first, _ = memory
        memory = batch, n + 1, first if n else event[0], event[0]
        if n + 1 == self.most:
            return (batch + 1, 0, 0, 0), [*out, (*memory, "size")]
        return memory, out

    def settle(self, memory, now):
        if memory[1] and now - memory[3] >= self.gap:
            return (memory[0] + 1, 0, 0, 0), [(*memory, "gap")]
        return memory, []

    def due(self, memory):
        return memory[3] + self.gap if memory[1] else None


class Thresholds(InOrder):
    """The first event at or over each threshold since the last opening; an opening forgets what was reached before, then counts itself."""

    memory = "part long, reached array<boolean>"
    columns = ["part", "threshold", "ts"]

    def __init__(self, thresholds: list[int]):
        self.thresholds = thresholds

    def fresh(self) -> tuple:
        return 0, [False] * len(self.thresholds)

    def step(self, memory, event):
        part, reached = memory
        ts, _, value, opens = event
        if opens:
            part, reached = part + 1, [False] * len(reached)
        new = [t for t, r in zip(self.thresholds, reached, strict=True) if value >= t and not r]
        return (part, [r or value >= t for t, r in zip(self.thresholds, reached, strict=True)]), [(part, t, ts) for t in new]


def keyed(events: DataFrame, key: str, opens, late: str) -> DataFrame:
    """events: ts, id, value. What the state machines read, behind a watermark."""
    ship(events.sparkSession)
    rows = events.withWatermark("ts", late)
    return rows.select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("micros"), "id", F.coalesce(F.col("value").cast("double"), F.lit(float("-inf"))).alias("value"), F.coalesce(opens, F.lit(False)).alias("opens"))


def flushed(events: DataFrame, key: str, most: int = 10, gap_seconds: float = 2, late: str = "10 seconds") -> DataFrame:
    """key, batch, n, first_ts, last_ts, why (size or gap): the batches that a client's buffer is sent in."""
    rows = keyed(events, key, F.lit(False), late)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, batch long, n int, first_ts timestamp, last_ts timestamp, why string"
    return rows.groupBy("key").transformWithStateInPandas(Flush(most, int(gap_seconds * 1e6)), schema, "append", "EventTime").withColumnRenamed("key", key)


def reached(events: DataFrame, key: str, opens, thresholds: list[int], late: str = "10 seconds") -> DataFrame:
    """key, part, threshold, ts: thresholds once each between two openings."""
    rows = keyed(events, key, opens, late)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, part long, threshold int, ts timestamp"
    return rows.groupBy("key").transformWithStateInPandas(Thresholds(thresholds), schema, "append", "EventTime").withColumnRenamed("key", key)


def unanswered(asked: DataFrame, answers: DataFrame, key: str, within: str, late: str = "10 seconds") -> DataFrame:
    """asked (key, ts, id) for which no answer (key, ts) came from its time on up to `within` later: given out when the watermark has passed
    that. Both sides forget what no row can meet any more."""
    a = asked.withWatermark("ts", late)
    b = answers.select(F.col(key).alias("_key"), F.col("ts").alias("_ts")).withWatermark("_ts", late)
    met = a.join(b, F.expr(f"{key} = _key AND _ts >= ts AND _ts <= ts + INTERVAL {within}"), "leftOuter")
    return met.where("_key IS NULL").select(key, "ts", "id")
