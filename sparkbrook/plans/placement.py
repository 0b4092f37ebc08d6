"""Placement of analysis operators on threads (scheduler pools): pure functions over what is running."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PlacementError(ValueError):
    """An operator that can't be placed or moved."""


@dataclass(frozen=True)
class Thread:
    plugins: int = 0
    utilization: int = 0
    max_mps: int = 0


def least_used(threads: Sequence[Thread], limit: int) -> int | None:
    """The thread with the lowest utilization, of equals the one with fewest plugins; None if it is at the limit (0: no limit)."""
    best = min(range(len(threads)), key=lambda i: (threads[i].utilization, threads[i].plugins))
    return None if limit and threads[best].utilization >= limit else best


def startup_thread(asked: int | None, before: int | None, threads: Sequence[Thread]) -> int:
    """At startup: the asked one (any number, modulo), else where it ran before, else where fewest plugins are."""
    if asked is not None:
        return asked % len(threads)
    if before is not None and before < len(threads):
        return before
    return min(range(len(threads)), key=lambda i: threads[i].plugins)


def load_thread(asked: int | None, running_on: int | None, threads: Sequence[Thread], limit: int) -> int:
    """While running: a plugin never moves to another thread; a new one goes where it asks or to the least used."""
    if running_on is not None:
        if asked is not None and asked % len(threads) != running_on:
            raise PlacementError("a running plugin can't be restarted on another thread")
        return running_on
    if asked is not None:
        return asked % len(threads)
    free = least_used(threads, limit)
    if free is None:
        raise PlacementError("all threads are at the utilization limit")
    return free


def added(thread: Thread) -> Thread:
    """Until the next measurement, a plugin more counts as five per cent; the estimate of the most messages starts anew."""
    return replace(thread, plugins=thread.plugins + 1, utilization=min(255, thread.utilization + 5), max_mps=0)


def removed(thread: Thread) -> Thread:
    return replace(thread, plugins=thread.plugins - 1, utilization=max(0, thread.utilization - 5), max_mps=0)


# The same rules over tables: a cluster's worth of engines at once.


def least_used_threads(threads: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """(*by, thread, blocked): the thread each engine would load a plugin on. ``threads``: *by, thread, plugins, utilization."""
    order = F.struct("utilization", "plugins", "thread")
    best = threads.groupBy(*by).agg(F.min(order).alias("__best"))
    blocked = F.lit(bool(limit)) & (F.col("__best")["utilization"] >= limit)
    return best.select(*by, F.when(~blocked, F.col("__best")["thread"]).alias("thread"), blocked.alias("blocked"))


def placed_at_load(plugins: DataFrame, n_threads: Column) -> DataFrame:
    """With ``on``, the thread of each plugin, and ``refused``. ``plugins``: asked, running_on (null: isn't running), least_used (null: all are at the limit)."""
    asked = F.pmod(F.col("asked"), n_threads)
    running = F.col("running_on").isNotNull()
    refused = F.coalesce(running & (asked != F.col("running_on")), F.lit(False)) | (~running & F.col("asked").isNull() & F.col("least_used").isNull())
    return plugins.withColumns({"refused": refused, "on": F.when(~refused, F.coalesce("running_on", asked, "least_used"))})


def adjusted_utilization(threads: DataFrame, added_: Column, removed_: Column) -> DataFrame:
    """``threads`` (utilization, max_mps) after plugins were added and removed: five per cent each, between 0 and 255; the estimate of the most messages starts anew where any was."""
    changed = (added_ + removed_) > 0
    return threads.withColumns({"utilization": F.greatest(F.least(F.col("utilization") + 5 * added_, F.lit(255)) - 5 * removed_, F.lit(0)), "max_mps": F.when(changed, 0).otherwise(F.col("max_mps"))})


def code_places(plugins: DataFrame, run: DataFrame, installed: DataFrame) -> DataFrame:
    """With ``place``: run, installed, or null if no code is there. All have ``filename``."""
    own, other = (x.select("filename").distinct().withColumn(name, F.lit(True)) for x, name in ((run, "__run"), (installed, "__installed")))
    met = plugins.join(own, "filename", "left").join(other, "filename", "left")
    return met.withColumn("place", F.when(F.col("__run"), "run").when(F.col("__installed"), "installed")).drop("__run", "__installed")
