"""A batch run of the engine: messages through analysis operators to outputs, as one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matcher import compile_matcher
from ..operators import merge, routing, ticks
from .config import OperatorSpec

#: Code of an analysis operator: from its windowed messages (window_id, clk, fires) to emissions (window_id, payload_name, payload).
Analysis = Callable[[DataFrame], DataFrame]


@dataclass
class Engine:
    """Analysis operators with their code, and outputs."""

    analyses: Mapping[str, tuple[OperatorSpec, Analysis]]
    outputs: Mapping[str, OperatorSpec]
    promoted: Mapping[str, str] | None = None

    def analyse(self, messages: DataFrame) -> DataFrame:
        """What all analyses emit, limited per tick. Timers of one interval share their windows; every operator sees all messages' clocks, but only matching rows."""
        windows: dict[int, DataFrame] = {}
        out = []
        for name, (spec, code) in self.analyses.items():
            interval = spec.ticker_interval
            if interval and interval not in windows:
                windows[interval] = ticks.windowed(messages, interval)
            rows = windows[interval] if interval else messages.withColumns({"window_id": F.lit(0).cast("long"), "fires": F.lit(False), "clk": F.lit(None).cast("long")})
            emitted = code(rows.where(compile_matcher(spec.message_matcher, self.promoted))).withColumn("plugin", F.lit(name))
            out.append(ticks.emission_limit(emitted, spec.timer_event_inject_limit, ["window_id"], ["payload_name"]).where("accepted").drop("accepted"))
        return routing.multiplex(*out)

    def deliver(self, messages: DataFrame) -> dict[str, DataFrame]:
        """What each output gets of messages of both queues, oldest first."""
        merged = merge.delivery_order(messages)
        return {name: routing.match(routing.read_queue(merged, spec.read_queue), spec.message_matcher, self.promoted) for name, spec in self.outputs.items()}


def counter(rows: DataFrame) -> DataFrame:
    """The counting analysis: the running number of its messages, emitted at each tick."""
    per = rows.groupBy("window_id").agg(F.count("*").alias("n"))
    from ..operators.running import running

    return running(per, F.col("n"), "n_total", pos="window_id").select("window_id", F.lit("count").alias("payload_name"), F.col("n_total").cast("string").alias("payload"))
