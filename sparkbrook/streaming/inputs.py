"""Inputs in user code: a streaming source that calls ``process_message`` once a poll, with the checkpoint to go on from."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..plans.config import OperatorSpec

#: Longest string checkpoint, in characters.
CHECKPOINT_CHARACTERS = 8191
COLUMNS = {"uuid": "string", "timestamp_ns": "bigint", "type": "string", "logger": "string", "severity": "int", "payload": "string", "env_version": "string", "pid": "int", "hostname": "string"}
LOG = logging.getLogger("sparkbrook.input")


class InputFailure(RuntimeError):
    """An input that ended for good."""


class Input:
    """Base of user code. ``process_message`` injects any number of messages and gives 0 (done until the next poll), below 0 (failure: logged, polled again) or above 0 (fatal)."""

    def __init__(self, read_config: Callable[[str], object], inject_message: Callable[..., None], log: Callable[..., None]):
        self.read_config, self.inject_message, self.log = read_config, inject_message, log

    def process_message(self, checkpoint: float | str | None) -> int | tuple[int, str]:
        return 0


class _Run:
    """What one poll of an input gives: rows, and the checkpoint after each of them."""

    def __init__(self, factory: Callable[..., Input], spec: OperatorSpec, start: dict):
        self.checkpoint, self.rows, self.after = start.get("cp"), [], []
        self.spec = spec
        self.synced = False
        code = factory(spec.read_config, self.inject, self.log).process_message(self.checkpoint)
        code, error = code if isinstance(code, tuple) else (code or 0, "")
        if code > 0:
            raise InputFailure(f"{spec.name}: {error or f'process_message returned {code}'}")
        if code < 0:
            LOG.warning("%s: process_message returned %d %s", spec.name, code, error)

    def log(self, *parts: object) -> None:
        """``print`` of user code: a line of the debug log."""
        LOG.debug("%s: %s", self.spec.name, "\t".join(map(str, parts)))

    def inject(self, message: dict | None, checkpoint: float | str | None = None) -> None:
        """A message, or None to move the checkpoint alone; the checkpoint is a number or a string."""
        if message is None and checkpoint is None:
            raise InputFailure("neither a message nor a checkpoint")
        if isinstance(checkpoint, str) and len(checkpoint) > CHECKPOINT_CHARACTERS:
            raise InputFailure(f"a checkpoint of over {CHECKPOINT_CHARACTERS} characters")
        if checkpoint is not None and (isinstance(checkpoint, bool) or not isinstance(checkpoint, (int, float, str))):
            raise InputFailure("a checkpoint is a number or a string")
        if checkpoint is not None:
            self.checkpoint, self.synced = checkpoint, True
        if message is not None:
            known = {"logger": self.spec.name, **message}
            self.rows.append(tuple(known.get(c) for c in COLUMNS))
            self.after.append(self.checkpoint)


class _Reader(SimpleDataSourceStreamReader):
    """Offsets are the checkpoint and the messages that came after it without one of their own."""

    def __init__(self, factory: Callable[..., Input], spec: OperatorSpec, first: float | str | None):
        self.factory, self.spec, self.first = factory, spec, first

    def initialOffset(self) -> dict:
        return {"cp": self.first, "n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        run = _Run(self.factory, self.spec, start)
        if run.checkpoint != start.get("cp"):
            return iter(run.rows), {"cp": run.checkpoint, "n": 0}
        return iter(run.rows), {"cp": run.checkpoint, "n": start["n"] + len(run.rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows after a restart: the input runs again from the checkpoint it had."""
        run = _Run(self.factory, self.spec, start)
        if end["cp"] == start.get("cp"):
            return iter(run.rows[: end["n"] - start["n"]])
        last = max((i for i, cp in enumerate(run.after) if cp == end["cp"]), default=len(run.rows) - 1)
        return iter(run.rows[: last + 1])

    def commit(self, end: dict) -> None:
        pass


def input_stream(spark: SparkSession, spec: OperatorSpec, factory: Callable[..., Input], first: float | str | None = None) -> DataFrame:
    """A stream of an input's messages. Each micro-batch is one poll; the query's trigger is the polling interval, and its checkpoint folder keeps the input's checkpoint."""
    columns = ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items())
    label = "sparkbrook_" + "".join(c if c.isalnum() else "_" for c in spec.name)

    class InputSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return columns

        def simpleStreamReader(self, schema) -> _Reader:
            return _Reader(factory, spec, first)

    spark.dataSource.register(InputSource)
    return spark.readStream.format(label).load()
