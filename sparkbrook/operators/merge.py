"""Order: oldest-first merge of two queues, first-in first-out order, and counted places along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def heads(messages: DataFrame, queue: str = "queue", ns: str = "timestamp_ns", pos: str = "pos") -> DataFrame:
    """With ``head_ns``: the latest timestamp of the queue up to the message. A reader that always takes the older head of two queues delivers in order
    of this, not of the timestamp itself: an old message waits behind newer ones of its own queue."""
    return running(messages, F.col(ns), "head_ns", pos=pos, by=[queue], fold="max")


def delivery_key(queue: str = "queue", pos: str = "pos") -> list[Column]:
    """What a complete backlog is delivered in order of: the heads, ties from the input queue first, then the place in the queue."""
    return [F.col("head_ns"), F.when(F.col(queue) == "input", 0).otherwise(1), F.col(pos)]


def merge_oldest_first(messages: DataFrame, queue: str = "queue", ns: str = "timestamp_ns", pos: str = "pos") -> DataFrame:
    """All messages sorted by delivery: a distributed sort by ranges, no single task."""
    return heads(messages, queue, ns, pos).orderBy(*delivery_key(queue, pos))


def delivery_order(messages: DataFrame, queue: str = "queue", ns: str = "timestamp_ns", pos: str = "pos", span: int = 10_000_000_000) -> DataFrame:
    """With ``seq``, the place in the delivery from 1 on.

    A message's place is its number in its own queue and the messages of the other queue that go before its head. Along a queue heads only rise, so the second is a number for each
    distinct head: heads with their counts are summed up along time, in blocks of ``span`` nanoseconds, and what comes out is carried along the queue by a running maximum. So
    neither a far timestamp, which makes one head of all that follows, nor a busy hour puts the stream in one task.
    """
    rows = running(heads(messages, queue, ns, pos), F.lit(1), "__rank", pos=pos, by=[queue], fold="count")
    groups = rows.groupBy(queue, "head_ns").agg(F.min(pos).alias(pos), F.min("__rank").alias("__first"), F.count("*").alias("__n"))
    first_served = F.col(queue) == "input"
    by_head = groups.groupBy("head_ns").agg(F.sum("__n").alias("__n"), F.sum(F.when(first_served, F.col("__n")).otherwise(0)).alias("__inputs"))
    before = running(by_head, F.col("__n"), "__before", pos="head_ns", before=True, block=span).select("head_ns", "__before", "__inputs")
    shift = F.col("__before") + F.when(first_served, 0).otherwise(F.col("__inputs")) - F.col("__first") + 1
    shifts = groups.join(before, "head_ns").select(queue, pos, shift.alias("__shift"))
    marked = running(rows.join(shifts, [queue, pos], "left"), F.col("__shift"), "__others", pos=pos, by=[queue], fold="max")
    return marked.withColumn("seq", F.col("__others") + F.col("__rank")).drop("__rank", "__shift", "__others")


def fifo(messages: DataFrame) -> DataFrame:
    """By file, then by offset."""
    return messages.orderBy("file_id", "offset")
