"""Routing: matchers, queue choice, guards, projections, multiplexing and fan-out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matcher import compile_matcher
from ..schema import BOOL, DOUBLE, STRING

READ_QUEUES = {"both": ("input", "analysis"), "input": ("input",), "analysis": ("analysis",)}


def match(messages: DataFrame, expression: str, promoted: Mapping[str, str] | None = None) -> DataFrame:
    """Messages that an expression takes: a plain filter, so it reaches the scan."""
    return messages.where(compile_matcher(expression, promoted))


def read_queue(messages: DataFrame, which: str = "both") -> DataFrame:
    return messages.where(F.col("queue").isin(*READ_QUEUES[which]))


def size_guard(messages: DataFrame, limit: int, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by size in bytes of a column; nothing is lost, and a null has size 0."""
    small = F.coalesce(F.octet_length(column), F.lit(0)) <= limit
    return messages.where(small), messages.where(~small)


def decode_or_route(messages: DataFrame, decoded: Column, name: str = "decoded") -> tuple[DataFrame, DataFrame]:
    """(decoded, failures): rows whose decoder gave null go aside whole."""
    rows = messages.withColumn(name, decoded)
    return rows.where(F.col(name).isNotNull()), rows.where(F.col(name).isNull()).drop(name)


def promote(messages: DataFrame, field: str, column: str, kind: int = STRING) -> DataFrame:
    """A field of ``fields`` moved to a column of its own."""
    slot = {STRING: "v_string", DOUBLE: "v_double", BOOL: "v_bool"}[kind]
    value = F.get(F.filter("fields", lambda f: f["name"] == field), F.lit(0))[slot]
    return messages.withColumns({column: value, "fields": F.filter("fields", lambda f: f["name"] != field)})


def header_defaults(messages: DataFrame, defaults: Mapping[str, object], uuid_from: Sequence[str] = ("pos",)) -> DataFrame:
    """Empty header columns filled; a uuid is derived from the message's place, so a rerun gives the same."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    digest = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in uuid_from]), 256)
    return messages.withColumns(filled | {"uuid": F.coalesce("uuid", digest)})


def restricted(messages: DataFrame, logger: str, hostname: str, restrict: bool = True) -> DataFrame:
    """Logger and hostname set by the engine: over what the plugin says if restricted, else only where it says nothing."""
    put = (lambda c, v: F.lit(v)) if restrict else (lambda c, v: F.coalesce(F.col(c), F.lit(v)))
    return messages.withColumns({"logger": put("logger", logger), "hostname": put("hostname", hostname)})


def at_level(messages: DataFrame, level: int) -> DataFrame:
    """Log messages up to a level; a level outside 0 to 7 counts as 6."""
    return messages.where(F.col("severity") <= (level if 0 <= level <= 7 else 6))


def multiplex(*streams: DataFrame) -> DataFrame:
    """All producers in one stream."""
    out = streams[0]
    for other in streams[1:]:
        out = out.unionByName(other)
    return out


def fan_out(messages: DataFrame, plugins: Mapping[str, Column]) -> DataFrame:
    """A row for each message and plugin that takes it, from one scan: ``plugin`` names it."""
    taken = F.array_compact(F.array(*[F.when(matcher, F.lit(name)) for name, matcher in plugins.items()]))
    return messages.withColumn("plugin", F.explode(taken))


def feedback(messages: DataFrame, produce, depth: int = 1) -> DataFrame:
    """Messages with those that outputs put back into the input queue, ``depth`` rounds at most. ``produce``: DataFrame -> DataFrame of the same columns."""
    out = now = messages.withColumn("round", F.lit(0))
    for k in range(1, depth + 1):
        now = produce(now.drop("round")).withColumn("round", F.lit(k))
        out = out.unionByName(now)
    return out


def enrich(messages: DataFrame, lookup: DataFrame, on: str, key: str, columns: Mapping[str, str], *, broadcast_rows: int = 100_000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Lookup values added as ``<on>_<suffix>``; a table of at most ``broadcast_rows`` rows and ``broadcast_bytes`` bytes of text is broadcast, a larger one is joined by shuffle."""
    slim = lookup.select(F.col(key).alias("__key"), *[F.col(c).alias(f"{on}_{suffix}") for suffix, c in columns.items()]).dropDuplicates(["__key"])
    bytes_ = F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in slim.columns), F.lit(0)))
    rows, size = slim.limit(broadcast_rows + 1).agg(F.count("*"), bytes_).first()
    small = rows <= broadcast_rows and (size or 0) <= broadcast_bytes
    return messages.join(F.broadcast(slim) if small else slim, F.col(on) == F.col("__key"), "left").drop("__key")
