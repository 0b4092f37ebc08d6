"""The plugin interface: user code called once a message and once a tick, with state, emissions and limits.

Built-in operators are the fast way; this is for what they can't express. A plugin's state is one object, so its messages go through one task in order of
position; give ``key`` columns to have one instance for each key, in parallel. Messages are filtered by the matcher and cut to ``columns`` before they reach Python,
but every message's clock drives the timer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import OperatorSpec

OUT = "plugin string, kind string, pos long, clk long, payload_type string, payload_name string, payload string"


class LimitError(RuntimeError):
    """More emissions in one call than are allowed."""


class Plugin:
    """Base of user code. ``process_message`` gives 0 (done), below 0 (failure: counted, goes on) or above 0 (fatal: nothing more is processed)."""

    def __init__(self, read_config: Callable[[str], object], inject_payload: Callable[[str, str, object], None]):
        self.read_config, self.inject_payload = read_config, inject_payload

    message: dict = {}

    def read_message(self, name: str) -> object:
        """A column of the message at hand; ``raw``: the message encoded, ``framed``: with its frame (of the columns that the plugin gets)."""
        from ..sources.codec import encode, frame

        if name in ("raw", "framed") and name not in self.message:
            return encode(self.message) if name == "raw" else frame(encode(self.message))
        return self.message.get(name)

    def process_message(self, message: dict) -> int | tuple[int, str]:
        return 0

    def timer_event(self, clk: int, shutdown: bool) -> None:
        pass


class _Runner:
    """One instance of a plugin and what the engine keeps for it."""

    def __init__(self, spec: OperatorSpec, factory: Callable[..., Plugin]):
        self.spec, self.out, self.left, self.pos = spec, [], 0, None
        self.clk = self.due = 0
        self.failures, self.ended = 0, False
        self.plugin = factory(spec.read_config, self.inject)

    def row(self, kind: str, payload_type: str | None, name: str | None, payload: object) -> None:
        self.out.append((self.spec.name, kind, self.pos, self.clk, payload_type, name, None if payload is None else str(payload)))

    def inject(self, payload_type: str, name: str, payload: object) -> None:
        if self.left <= 0:
            raise LimitError("inject_payload limit exceeded")
        if len(str(payload).encode()) > self.spec.output_limit:
            raise LimitError("output_limit exceeded")
        self.left -= 1
        self.row("emission", payload_type, name, payload)

    def call(self, limit: int, f: Callable, *args: object) -> object:
        self.left = limit
        try:
            return f(*args)
        except Exception as e:  # a plugin's own fault ends the plugin, not the engine
            self.end(str(e))
            return None
        finally:
            self.left = 0

    def end(self, error: str) -> None:
        self.row("terminated", None, None, error)
        self.ended = True

    def message(self, pos: int, sec: int, taken: bool, message: dict) -> None:
        self.pos, self.clk = pos, max(self.clk, sec)
        if taken:
            self.plugin.message = message
            code = self.call(self.spec.process_message_inject_limit, self.plugin.process_message, message)
            code, error = code if isinstance(code, tuple) else (code or 0, "")
            if code > 0 and not self.ended:
                self.end(error or f"process_message returned {code}")
            self.failures += code < 0
        if not self.ended and self.spec.ticker_interval and self.clk >= self.due:
            self.call(self.spec.timer_event_inject_limit, self.plugin.timer_event, self.clk, False)
            self.due = self.clk + self.spec.ticker_interval

    def shutdown(self) -> None:
        if not self.ended:
            self.call(self.spec.timer_event_inject_limit, self.plugin.timer_event, self.clk, True)
        if self.failures:
            self.row("failures", None, None, self.failures)


def run_plugin(messages: DataFrame, spec: OperatorSpec, factory: Callable[..., Plugin], matcher: Column, *, columns: Sequence[str] = (), key: Sequence[str] = (), pos: str = "pos", ns: str = "timestamp_ns") -> DataFrame:
    """(plugin, kind, pos, clk, payload_type, payload_name, payload, *key): emissions, and rows of kind ``terminated`` and ``failures``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys, wanted = list(key), list(columns)
    sec = F.call_function("div", F.col(ns), F.lit(1_000_000_000).cast("long"))
    slim = messages.select(*keys, F.col(pos).cast("long").alias("__pos"), sec.alias("__sec"), F.coalesce(matcher, F.lit(False)).alias("__taken"), *[F.col(c).alias(f"__m_{c}") for c in wanted])
    dealt = (slim.repartition(*keys) if keys else slim.repartition(1)).sortWithinPartitions(*keys, "__pos")
    schema = f"{OUT}" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name in keys)
    empty = messages.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner, at = None, None

        def flushed(rows: list, k: tuple) -> list:
            out = [(*r, *k) for r in rows]
            rows.clear()
            return out

        for batch in batches:
            out: list = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                k, (p, s, taken), rest = row[: len(keys)], row[len(keys) : len(keys) + 3], row[len(keys) + 3 :]
                if runner is None or k != at:
                    if runner is not None:
                        runner.shutdown()
                        out += flushed(runner.out, at)
                    runner, at = _Runner(spec, factory), k
                if not runner.ended:
                    runner.message(p, s, taken, dict(zip(wanted, rest, strict=True)) if taken else {})
            if runner is not None:
                out += flushed(runner.out, at)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if runner is not None:
            runner.shutdown()
            if out := flushed(runner.out, at):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, schema)


class Counter(Plugin):
    """Counts its messages; emits the count so far at each tick."""

    n = 0

    def process_message(self, message: dict) -> int:
        self.n += 1
        return 0

    def timer_event(self, clk: int, shutdown: bool) -> None:
        self.inject_payload("txt", "count", self.n)
