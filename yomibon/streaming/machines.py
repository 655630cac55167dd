"""State machines by key: what of a player's positions is saved, and which jobs have stalled.

Each machine is one step function of (state, event). On streams it runs in transformWithState, with its state
in the state store and event-time timers; its batch twin folds the same step over a key's events in order. Time is the
events' own, so a result doesn't depend on when a stream is run or how it is cut in batches, as long as events
come in order of time; a store that keeps state by changes (RocksDB) is required (`stores`).
Events of equal time are taken by their number. A null position is not saved; a null time is not an event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: A position is saved from so many seconds on, that far from the one saved last in a chapter, and so long after it.
FLOOR, LEAST, THROTTLE = 5.0, 1.0, 1.0
STALL_SECONDS = 600
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


def stores(spark: SparkSession) -> None:
    """Sets the state store that transformWithState needs, where the session names none."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, ROCKS)


def saves(state: tuple | None, chapter, position: float, at: int, least: float, throttle: float, floor: float) -> bool:
    """Whether a position is saved; state: (chapter, position, time) of the last one saved, times in microseconds."""
    if position is None or position != position or abs(position) == float("inf") or position < floor:
        return False
    if state is None:
        return True
    return not (state[0] == chapter and abs(state[1] - position) < least) and at - state[2] >= throttle * MICROS


class Saver(StatefulProcessor):
    """Rows (key, at, seq, chapter, position) -> those that are saved."""

    def __init__(self, columns: list[str], least: float, throttle: float, floor: float):
        self.columns, self.limits = columns, (least, throttle, floor)

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "chapter string, position double, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        state, keep = self.last.get() if self.last.exists() else None, []
        for chapter, position, at in zip(batch["chapter"], batch["position"], batch["at"], strict=True):
            kept = saves(state, chapter, position, int(at), *self.limits)
            state = (chapter, float(position), int(at)) if kept else state
            keep.append(kept)
        if any(keep):
            self.last.update(state)
        yield batch[keep][self.columns]

    def close(self) -> None:
        pass


def saved_flags(least: float, throttle: float, floor: float) -> Callable:
    @F.pandas_udf("array<boolean>")
    def flags(chapters: pd.Series, positions: pd.Series, times: pd.Series) -> pd.Series:
        def one(own: tuple) -> list[bool]:
            state, found = None, []
            for chapter, position, at in zip(*own, strict=True):
                found.append(saves(state, chapter, position, int(at), least, throttle, floor))
                state = (chapter, position, int(at)) if found[-1] else state
            return found

        return pd.Series([one(x) for x in zip(chapters, positions, times, strict=True)])

    return flags


def saved_positions(events: DataFrame, key: str, least: float = LEAST, throttle: float = THROTTLE, floor: float = FLOOR) -> DataFrame:
    """events (key, ts, seq, chapter, position) -> key, seq, chapter, position of those a player saves: not below `floor`,
    `least` from the last saved one of the same chapter, and `throttle` seconds after it. On streams in append mode."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where("ts is not null").select(key, at.alias("at"), "seq", F.col("chapter").cast("string").alias("chapter"), F.col("position").cast("double").alias("position"))
    columns = [key, "seq", "chapter", "position"]
    if events.isStreaming:
        stores(events.sparkSession)
        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
        return rows.groupBy(key).transformWithStateInPandas(Saver(columns, least, throttle, floor), schema, "Append", "None")
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "seq", "chapter", "position"))).alias("e"))
    part = lambda name: F.transform("e", lambda x: x[name])
    kept = F.filter(F.arrays_zip("e", saved_flags(least, throttle, floor)(part("chapter"), part("position"), part("at")).alias("keep")), lambda x: x["keep"])
    return found.select(key, F.explode(kept).alias("x")).select(key, "x.e.seq", "x.e.chapter", "x.e.position")


def stepped(state: tuple[str, int, int], kind: str, at: int, seconds: float) -> tuple[str, int, int]:
    """(status, events seen, time of the last) after an event. Only what runs times out, and what timed out stays so."""
    status, seen, last = state
    if status == "running" and at - last >= seconds * MICROS:
        status = "timeout"
    if status != "timeout":
        status = {"error": "failed", "purchase": "done"}.get(kind, "running")
    return status, seen + 1, at


class Job(StatefulProcessor):
    """Rows (key, at, seq, kind) and event-time timers -> key, status, seen: the state after each batch, and at a timeout."""

    def __init__(self, key: str, seconds: float):
        self.key, self.seconds = key, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, seen long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        state = self.state.get() if self.state.exists() else ("queued", 0, 0)
        for kind, at in zip(batch["kind"], batch["at"], strict=True):
            state = stepped(state, kind, int(at), self.seconds)
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state[0] == "running":
            self.handle.registerTimer(-(-(state[2] + int(self.seconds * MICROS)) // 1000))
        yield pd.DataFrame({self.key: [key[0]], "status": [state[0]], "seen": [state[1]]})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        status, seen, last = self.state.get()
        if status == "running" and timers.getCurrentWatermarkInMs() * 1000 - last >= self.seconds * MICROS:
            self.state.update(("timeout", seen, last))
            yield pd.DataFrame({self.key: [key[0]], "status": ["timeout"], "seen": [seen]})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, key: str, seconds: float = STALL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """events (key, ts, seq, kind) -> key, status, seen: queued, running, failed, done or timeout. A job times out when it
    runs and its next event comes `seconds` or more after the last, or when that time has passed for the stream. On
    streams in update mode, a row a change; the batch twin gives the last state of each key, the watermark being the last time."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where("ts is not null")
    if events.isStreaming:
        stores(events.sparkSession)
        rows = rows.withWatermark("ts", late).select(key, "ts", at.alias("at"), "seq", "kind")
        return rows.groupBy(key).transformWithStateInPandas(Job(key, seconds), f"`{key}` {rows.schema[key].dataType.simpleString()}, status string, seen long", "Update", "EventTime")
    rows = rows.select(key, at.alias("at"), "seq", "kind")
    # The watermark is in whole milliseconds, and a timer fires once it is behind it.
    mark = rows.agg(F.max("at").alias("mark")).withColumn("mark", F.expr("mark div 1000 * 1000"))
    gap = (F.lead("at").over(_order(key)) - F.col("at")) >= seconds * MICROS
    waits = F.lead("at").over(_order(key)).isNull() & (F.col("mark") - F.col("at") > seconds * MICROS)
    runs = ~F.col("kind").isin("error", "purchase") | F.col("kind").isNull()
    stalls = rows.crossJoin(F.broadcast(mark)).withColumn("stalls", runs & (F.coalesce(gap, F.lit(False)) | waits))  # one row of the last time
    last = stalls.groupBy(key).agg(F.bool_or("stalls").alias("stalls"), F.max(F.struct("at", "seq", "kind")).alias("last"), F.count(F.lit(1)).alias("seen"))
    status = F.when(F.col("stalls"), "timeout").when(F.col("last.kind") == "error", "failed").when(F.col("last.kind") == "purchase", "done").otherwise("running")
    return last.select(key, status.alias("status"), "seen")


def _order(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("at", "seq")
