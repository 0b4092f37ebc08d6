"""Data-driven timers: a tick fires after the first message whose clock has reached the expiry, which then moves to that clock plus the interval.

The clock is the latest timestamp so far, in seconds, and never goes back; the message that fires belongs to the window it closes; the
last window is closed by shutdown. Each expiry depends on the firing before, so the recurrence is one pass, but only over the distinct
seconds of the clock (their number grows with the time covered, not with the messages). The empty ticks before the first message are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seconds
from .running import running


def clocked(messages: DataFrame, ns: str = "timestamp_ns", pos: str = "pos") -> DataFrame:
    """With ``clk``: the clock after each message, in seconds."""
    return running(messages, seconds(F.col(ns)), "clk", pos=pos, fold="max")


def clock_seconds(clocked_messages: DataFrame, interval: int, pos: str = "pos") -> DataFrame:
    """(clk, pos, window_id, fires) of each distinct second of the clock: its first message, the ticks before it, and whether one follows that message."""
    if interval <= 0:
        raise ValueError("a ticker interval is positive")
    firsts = clocked_messages.groupBy("clk").agg(F.min(pos).alias(pos))  # the first message of each second of the clock

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due, ticks = 0, 0
        for batch in batches:
            fires, before = [], []
            for clk in batch.column(0).to_pylist():
                before.append(ticks)
                fires.append(clk >= due)
                if clk >= due:
                    due, ticks = clk + interval, ticks + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(fires)], ["clk", "pos", "window_id", "fires"])

    seconds_seen = firsts.select(F.col("clk").cast("long").alias("clk"), F.col(pos).cast("long").alias("pos"))
    return seconds_seen.repartition(1).sortWithinPartitions("clk").mapInArrow(run, "clk long, pos long, window_id long, fires boolean")


def triggers(clocked_messages: DataFrame, interval: int, pos: str = "pos") -> DataFrame:
    """(clk, pos) of the messages after which a tick fires."""
    return clock_seconds(clocked_messages, interval, pos).where("fires").select("clk", "pos")


def windowed(messages: DataFrame, interval: int, ns: str = "timestamp_ns", pos: str = "pos") -> DataFrame:
    """With ``clk``, ``fires`` (a tick follows the message) and ``window_id``: ticks before it.

    All messages of a second of the clock lie in the window of its first one or, after a tick, in the next: the seconds are met with the messages, which Spark does by
    broadcast while they are few, by its own measure of their size.
    """
    seconds_seen = clock_seconds(clocked(messages.select(pos, ns), ns, pos), interval, pos).select("clk", F.col("pos").alias("__first"), F.col("window_id").alias("__window"), F.col("fires").alias("__fires"))
    met = clocked(messages, ns, pos).join(seconds_seen, "clk")
    after = F.col("__fires") & (F.col(pos) > F.col("__first"))
    return met.withColumns({"fires": F.col("__fires") & (F.col(pos) == F.col("__first")), "window_id": F.col("__window") + after.cast("long")}).drop("__first", "__window", "__fires")


def tick_counts(windowed_messages: DataFrame, matcher=None, pos: str = "pos") -> DataFrame:
    """A row for each window: window_id, tick_clk (null for the last, closed by shutdown), is_shutdown, n, n_total (cumulative, never reset).

    Messages that don't match count as 0 but still drive the timer.
    """
    hit = F.lit(True) if matcher is None else matcher
    per = windowed_messages.groupBy("window_id").agg(F.count_if(hit).alias("n"), F.max(F.when(F.col("fires"), F.col("clk"))).alias("tick_clk"), F.count("*").alias("n_messages"))
    out = running(per, F.col("n"), "n_total", pos="window_id")
    return out.select("window_id", "tick_clk", F.col("tick_clk").isNull().alias("is_shutdown"), "n_messages", "n", "n_total")


def emission_limit(emissions: DataFrame, limit: int, call: list[str], order: list[str]) -> DataFrame:
    """With ``accepted``: whether an emission is among the first ``limit`` of its call (0: none may be)."""
    return emissions.withColumn("accepted", F.row_number().over(Window.partitionBy(*call).orderBy(*order)) <= limit)


def wall_ticks(messages: DataFrame, second: Column, interval: int, *, start: int, end: int, stagger: int = 0) -> DataFrame:
    """(tick, tick_clk, n, n_total): counts at ticks of a wall clock that runs from second ``start`` to ``end``, by the second each message came in.

    The first tick comes ``min(stagger, interval - 1, 59)`` seconds after the start, each next one an interval later, and ticks without messages fire too. A second's messages come
    before its tick; what comes after the last tick belongs to the shutdown, which has no tick_clk. The ticks are numbers of a range; messages are grouped by arithmetic.
    """
    if interval <= 0:
        raise ValueError("a ticker interval is positive")
    first = start + min(stagger, interval - 1, 59)
    n_ticks = max(0, (end - first) // interval + 1)
    at = F.least(F.greatest(F.ceil((second - F.lit(first)) / F.lit(interval)), F.lit(0)), F.lit(n_ticks)).cast("long")
    counts = messages.select(at.alias("tick")).groupBy("tick").agg(F.count("*").alias("n"))
    every = messages.sparkSession.range(n_ticks + 1).select(F.col("id").alias("tick"), F.when(F.col("id") < n_ticks, F.col("id") * interval + first).alias("tick_clk"))
    met = every.join(counts, "tick", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return running(met, F.col("n"), "n_total", pos="tick").select("tick", "tick_clk", "n", "n_total")
