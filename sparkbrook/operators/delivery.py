"""Delivery results of outputs and the positions they commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running

#: Result codes of an output; other positive ones are fatal.
SENT, FAIL, SKIP, RETRY, BATCH, ASYNC = 0, -1, -2, -3, -4, -5


def committed(results: DataFrame, by: list[str] | None = None, pos: str = "pos", code: str = "code", acked: str | None = None) -> DataFrame:
    """With ``commits`` and ``cp``: the position after each message.

    BATCH holds until the next SENT; RETRY doesn't commit. ASYNC commits by its acknowledgement (column ``acked``, if there is one): from the first that isn't acknowledged on nothing
    commits. A fatal code (above 0) ends the output: neither it nor anything after it commits. FAIL commits, the message is given up, but it doesn't let held ones go. A message
    that no matcher took has a null code and commits.
    """
    keys = by or []
    done = F.coalesce(F.col(acked), F.lit(False)) if acked else F.lit(False)
    ended = (F.col(code) > 0) | ((F.col(code) == ASYNC) & ~done)
    turn = F.when(F.col(code) == BATCH, True).when(F.col(code) == SENT, False)
    # what turned the hold last decides; an end stands after all turns
    at = F.when(ended, F.struct(F.lit(2**63 - 1).alias("at"), F.lit(True).alias("on"))).when(turn.isNotNull(), F.struct(F.col(pos).cast("long").alias("at"), turn.alias("on")))
    rows = running(results, at, "__held", pos=pos, by=keys, fold="max")
    over = F.coalesce(F.col("__held")["at"] == 2**63 - 1, F.lit(False))
    held = F.coalesce(F.col("__held")["on"], F.lit(False))
    commits = F.when(over, False).when(F.col(code) == ASYNC, True).otherwise(~held & ~F.coalesce(F.col(code).isin(BATCH, RETRY), F.lit(False)))
    return running(rows.withColumn("commits", commits).drop("__held"), F.when(F.col("commits"), F.col(pos)), "cp", pos=pos, by=keys, fold="max")


def commit_latest(acks: DataFrame, by: list[str]) -> DataFrame:
    """Position after acknowledgements: the latest acknowledged one, even if earlier ones are missing."""
    return acks.where("acked").groupBy(*by).agg(F.max("pos").alias("cp"))


def commit_contiguous(acks: DataFrame, by: list[str]) -> DataFrame:
    """Position up to which everything is acknowledged: just before the first that isn't."""
    first_gap = acks.groupBy(*by).agg(F.min(F.when(~F.col("acked"), F.col("pos"))).alias("__gap"))
    return acks.join(first_gap, by).where("__gap is null or pos < __gap").groupBy(*by).agg(F.max("pos").alias("cp"))


def ring_slot(sequence: Column, size: int) -> Column:
    """Slot of an in-flight position."""
    if size <= 0:
        raise ValueError("asynchronous results need a buffer")
    return F.pmod(sequence, F.lit(size))


def attempts(results: DataFrame, by: list[str]) -> DataFrame:
    """Messages with how often they were tried and their last result: a RETRY blocks what is behind it until another result comes."""
    last = F.max_by("code", "attempt")
    return results.groupBy(*by).agg(F.count("*").alias("tries"), last.alias("code"), (last == RETRY).alias("still_blocked"))


def dead_letters(results: DataFrame, code: str = "code") -> DataFrame:
    """Messages that were given up."""
    return results.where(F.col(code) == FAIL)


def terminated(results: DataFrame, by: list[str], pos: str = "pos", code: str = "code") -> DataFrame:
    """(plugin, pos): the first fatal result of each plugin; nothing after it is processed."""
    return results.where(F.col(code) > 0).groupBy(*by).agg(F.min(pos).alias(pos))


def replayed_once(messages: DataFrame, key: list[str]) -> DataFrame:
    """At-least-once delivery repeats messages after a crash: one row for each key."""
    return messages.dropDuplicates(key)
