"""Outputs of a stream: micro-batches handed to code by result codes, with retries and dead letters; starting and stopping."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.delivery import ASYNC, BATCH, FAIL, RETRY
from ..plans.lifecycle import stop_timeouts


class Fatal(RuntimeError):
    """An output asked to be terminated."""


def sink(
    output: Callable[[DataFrame, int], int], dead_letters: str | None = None, *, settled: Callable[[int], bool] | None = None, wait: float = 1.0, tries: int | None = None,
) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: calls ``output(batch, id)`` and acts on its code.

    RETRY: again after ``wait`` seconds, for ever or ``tries`` times; nothing behind it is delivered meanwhile. FAIL, and a RETRY whose tries are spent: the batch goes to
    ``dead_letters`` (Parquet) and the stream goes on; a spent RETRY without ``dead_letters`` ends the query, so nothing is lost. BATCH and ASYNC: the offsets wait
    until ``settled(id)`` says that what the output holds was acknowledged; without ``settled`` such a code ends the query. Positive: the query ends. The offsets are
    committed when this returns, so delivery is at least once; ``id`` lets an output make it exactly once.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            left = tries
            while (code := output(batch, batch_id)) == RETRY and (left is None or left > 1):
                left = None if left is None else left - 1
                time.sleep(wait)
            if code > 0:
                raise Fatal(f"code {code} in batch {batch_id}")
            if code in (BATCH, ASYNC):
                if settled is None:
                    raise Fatal(f"code {code} in batch {batch_id} and nothing to acknowledge it")
                while not settled(batch_id):
                    time.sleep(wait)
            elif code == RETRY and dead_letters is None:
                raise Fatal(f"batch {batch_id} was tried {tries} times")
            elif code in (FAIL, RETRY) and dead_letters is not None:
                batch.write.mode("append").parquet(dead_letters)
        finally:
            batch.unpersist()

    return deliver


class Acknowledgements:
    """Batches that an output has acknowledged: its callback calls ``acknowledge(id)``, which settles that batch and all before it."""

    def __init__(self) -> None:
        self.latest = -1

    def acknowledge(self, batch_id: int) -> None:
        self.latest = max(self.latest, batch_id)

    def settled(self, batch_id: int) -> bool:
        return batch_id <= self.latest


def triggered(writer: DataStreamWriter, ticker_interval: int, run_once: bool = False) -> DataStreamWriter:
    """0 seconds: once over what is there, or continuously; else polling."""
    if run_once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{ticker_interval} seconds") if ticker_interval > 0 else writer


def stop(query: StreamingQuery) -> bool:
    """Ask a query to stop and wait, longer at first; whether it ended."""
    for seconds in stop_timeouts():
        query.stop()
        if query.awaitTermination(seconds):
            return True
    return not query.isActive
