"""The tick counter as a stateful processor: the same windows as the batch operator, however the stream is cut into micro-batches."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "plugin string, window_id long, tick_clk long, n_messages long, n long, n_total long"


class TickCounter(StatefulProcessor):
    """State of a plugin: clock, expiry, and the counts of the open window. Rows are taken in order of position; ticks fire within the batch, as event-time timers would not."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "clk long, due long, window_id long, n_messages long, n long, n_total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clk, due, window, seen, n, total = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, 0)
        out = []
        batch = pd.concat(list(rows)).sort_values("pos")
        for sec, hit in zip((batch["timestamp_ns"] // 1_000_000_000).tolist(), batch["hit"].tolist(), strict=True):
            clk = max(clk, sec)
            seen, n, total = seen + 1, n + hit, total + hit
            if clk >= due:
                out.append((key[0], window, clk, seen, n, total))
                due, window, seen, n = clk + self.interval, window + 1, 0, 0
        self.state.update((clk, due, window, seen, n, total))
        yield pd.DataFrame(out, columns=["plugin", "window_id", "tick_clk", "n_messages", "n", "n_total"])

    def close(self) -> None:
        pass


def tick_stream(messages: DataFrame, interval: int, matcher, plugin: str = "analysis.counter") -> DataFrame:
    """(plugin, window_id, tick_clk, n_messages, n, n_total): a row for each tick. Needs the RocksDB state store."""
    rows = messages.select(F.lit(plugin).alias("plugin"), F.col("pos").cast("long").alias("pos"), "timestamp_ns", F.when(matcher, 1).otherwise(0).alias("hit"))
    return rows.groupBy("plugin").transformWithStateInPandas(TickCounter(interval), OUT, "Append", "None")


class WallClockCounter(StatefulProcessor):
    """A service's timer: counts of a plugin at ticks of the wall clock, which fire without data too. The first tick comes after ``stagger`` seconds, each next one an interval later."""

    def __init__(self, interval: int, stagger: int):
        self.interval, self.stagger = interval * 1000, stagger * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "n long, n_total long, started boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, started = self.state.get() if self.state.exists() else (0, 0, False)
        hits = sum(int(x["hit"].sum()) for x in rows)
        if not started:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stagger)
        self.state.update((n + hits, total + hits, True))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, total, _ = self.state.get()
        self.state.update((0, total, True))
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.interval)
        yield pd.DataFrame([(key[0], now // 1000, n, total)], columns=["plugin", "tick_clk", "n", "n_total"])

    def close(self) -> None:
        pass


def wall_clock_stream(messages: DataFrame, interval: int, matcher, plugin: str = "analysis.counter", stagger: int | None = None) -> DataFrame:
    """(plugin, tick_clk, n, n_total) at each tick of the wall clock. ``stagger``: seconds to the first tick; by default at random below the interval and a minute, so that plugins
    of one interval don't tick together. Needs the RocksDB state store and a trigger, which makes the idle ticks."""
    wait = random.randrange(max(1, min(interval, 60))) if stagger is None else stagger
    rows = messages.select(F.lit(plugin).alias("plugin"), F.when(matcher, 1).otherwise(0).alias("hit"))
    return rows.groupBy("plugin").transformWithStateInPandas(WallClockCounter(interval, wait), "plugin string, tick_clk long, n long, n_total long", "Append", "ProcessingTime")


def event_windows(messages: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Tumbling counts by event time with a watermark: for streams that may drop late data, which ticks never do."""
    ts = F.timestamp_micros(F.call_function("div", F.col("timestamp_ns"), F.lit(1000).cast("long")))
    return messages.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "type").agg(F.count("*").alias("n"))
