"""Operators with state a key, on streams of many small batches in mixed order, against the same in batch."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators import events as ev
from tesserae.streaming import events as streams
from tesserae.streaming import keyed
from tesserae.streaming.keyed import Flush, Thresholds


def arriving(spark, tmp_path, rows, files=6):
    """rows in files whose order of time is mixed by up to six hours."""
    mixed = rows.withColumn("_at", F.unix_micros("ts") + F.pmod(F.xxhash64("id"), F.lit(6 * 3600)) * 1_000_000)
    placed = mixed.withColumn("_file", F.ntile(files).over(Window.orderBy("_at"))).drop("_at")
    for k in range(1, files + 1):
        placed.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return lambda: streams.stream(spark, str(tmp_path / "in"), "*.parquet", rows.schema, files=1)


def some_events(spark, n=400):
    at = F.lit("2024-05-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 17).cast("int"), secs=F.pmod(F.xxhash64("id"), F.lit(7)).cast("decimal(18,6)"))
    kind = F.element_at(F.array(*map(F.lit, ["open", "view", "click", "view"])), (F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(4)) + 1).cast("int"))
    rows = spark.range(n).select("id", at.alias("ts"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(5)).alias("user"), kind.alias("type"), F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(130)).cast("double").alias("value"))
    last = spark.createDataFrame([(n + 1, 9, "end", 0.0)], "id long, user long, type string, value double").select("id", F.lit("2024-07-01").cast("timestamp").alias("ts"), "user", "type", "value")
    return rows.union(last)  # time goes on, so that all others are settled


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = some_events(spark)
    read = arriving(spark, tmp_path, rows)
    got = {tuple(r) for r in streams.run_to_end(keyed.flushed(read(), "user", 4, 3 * 3600, "1 day"), spark, "t").select("user", "batch", "n", "first_ts", "last_ts").collect()}
    want = {tuple(r) for r in ev.flushed(rows, "user", 4, "3 HOURS").where("user <> 9").collect()}
    assert got == want and {n for _, _, n, _, _ in got} == {1, 2, 3, 4}
    got = {tuple(r) for r in streams.run_to_end(keyed.reached(read(), "user", F.col("type") == "open", [25, 50, 100], "1 day"), spark, "t").collect()}
    want = {tuple(r) for r in ev.reached(rows, ["user"], F.col("type") == "open", "value", [25, 50, 100]).where("user <> 9").collect()}
    assert got == want and max(p for _, p, _, _ in got) > 5
    asked, answers = (lambda x: x.where("type = 'view'").select("user", "ts", "id")), (lambda x: x.where("type = 'click' OR type = 'end'"))
    views = lambda x: x.where("type IN ('view', 'end')").select("user", "ts", "id")
    got = {tuple(r) for r in streams.run_to_end(keyed.unanswered(views(read()), answers(read()), "user", "4 HOURS", "1 day"), spark, "t").where("user <> 9").collect()}
    assert got == {tuple(r) for r in ev.unanswered(asked(rows), answers(rows), "user", "4 HOURS").collect()} and got


def stepped(machine, events, end):
    memory, out = machine.fresh(), []
    for e in sorted(events):
        memory, given = machine.step(memory, e)
        out += given
    return out + machine.settle(memory, end)[1]


def test_state_machines():
    events = [(t, i, 0.0, False) for i, t in enumerate((0, 10, 300, 310, 320, 330, 430, 900))]
    assert stepped(Flush(3, 100), events, 999) == [(1, 2, 0, 10, "gap"), (2, 3, 300, 320, "size"), (3, 1, 330, 330, "gap"), (4, 1, 430, 430, "gap")]
    assert stepped(Flush(3, 100), events, 1000)[-1] == (5, 1, 900, 900, "gap")
    events = [(1, 1, 30.0, False), (2, 2, 60.0, True), (3, 3, 10.0, False), (4, 4, 99.0, False), (5, 5, 99.0, True)]
    assert stepped(Thresholds([25, 50]), events, 9) == [(0, 25, 1), (1, 25, 2), (1, 50, 2), (2, 25, 5), (2, 50, 5)]


class Store:
    """A list or a value of state, counting what is written."""

    def __init__(self):
        self.held, self.writes = [], 0

    def appendValue(self, v):
        self.held, self.writes = [*self.held, v], self.writes + 1

    def appendList(self, vs):
        self.held, self.writes = self.held + vs, self.writes + len(vs)

    def put(self, vs):
        self.held, self.writes = vs, self.writes + len(vs)

    def clear(self):
        self.held = []

    def exists(self):
        return bool(self.held)

    def get(self):
        return iter(self.held)


class Value(Store):
    def update(self, v):
        self.held = [v]

    def get(self):
        return self.held[0] if self.held else None


def test_waiting_events_are_few_values(spark):
    """Events come in two parts out of order; what waits is written in chunks, and goes on in the order of time."""
    machine, store, value, timers = Flush(3, 100), Store(), Value(), []
    machine.pending, machine.state, machine.wake = store, value, timers.append
    at = [900, 0, 430, 330, 320, 310, 300, 10]
    for part in (at[:4] * 500, at[4:] * 500):
        frame = pd.DataFrame({"micros": [t + 1000 * (i // 4) for i, t in enumerate(part)], "id": range(len(part)), "value": 0.0, "opens": False})
        machine.handleInputRows(("k",), iter([frame]), None)
    assert store.writes == 2 and timers == [0, 10]
    now = lambda ms: type("Now", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    got = pd.concat([*machine.handleExpiredTimer(("k",), now(200), None), *machine.handleExpiredTimer(("k",), now(501), None)])
    events = [(t + 1000 * k, 0, 0.0, False) for t in at for k in range(500)]
    want = stepped(Flush(3, 100), events, 501_000)
    assert [tuple(map(int, r)) for r in zip(got["batch"], got["n"], got["first_ts"].astype("int64"), got["last_ts"].astype("int64"), strict=True)] == [w[:4] for w in want]
    assert list(got["why"]) == [w[4] for w in want] and set(got["key"]) == {"k"} and not store.held
