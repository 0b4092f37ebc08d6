"""Sinks: queue files, reports as tab-separated text, checkpoint text, termination records."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import utc_second
from ..operators.checkpoints import text_lines
from ..operators.telemetry import PLUGIN_COLUMNS, UTILIZATION_COLUMNS
from ..schema import DOUBLE
from .codec import HEADER, LENGTH_TAG, RECORD, UNIT, encode, frame, put, put_varint
from .queue_files import FramedSource

#: Values of a column that an encoder remembers.
REMEMBERED = 100_000


def append_queue(messages: DataFrame, folder: str, limit: int = 64 << 20) -> None:
    """Append messages to a queue in a folder that all machines share, from all tasks at once, in order of the partitions; for a stream, ``writeStream.format("framed")``."""
    messages.sparkSession.dataSource.register(FramedSource)
    messages.write.format("framed").mode("append").options(path=folder, limit=limit).save()


def write_framed(messages: DataFrame, path: str) -> None:
    """Messages as framed bytes in Parquet, part by part on the executors: the form for large streams."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([frame(encode(r)) for r in batch.to_pylist()], pa.binary())], ["frame"])

    messages.mapInArrow(run, "frame binary").write.mode("append").parquet(path)


def framed_columns(messages: DataFrame, fields: dict[str, tuple[int, str | None]]) -> DataFrame:
    """(frame) of messages whose fields are columns of their own: ``fields`` gives kind (STRING or DOUBLE) and representation of each; header columns go by their names.

    Columns are encoded batch by batch. What repeats is remembered, so a message costs a few lookups.
    """
    import struct

    import pyarrow as pa

    headers = [(n, name, kind) for n, (name, kind) in HEADER.items() if name in messages.columns and name not in fields]

    def field_encoder(name: str, kind: int, representation: str | None):
        head = put(1, "text", name) + put(2, "int", kind) + (b"" if representation is None else put(3, "text", representation))
        known: dict = {}

        def encode_value(v) -> bytes:
            if v is None:
                return b""
            out = known.get(v)
            if out is None:
                part = head + (b"\x39" + struct.pack("<d", v) if kind == DOUBLE else put(4, "text", v))
                out = b"\x52" + put_varint(len(part)) + part
                if len(known) < REMEMBERED:
                    known[v] = out
            return out

        return encode_value

    def header_encoder(n: int, kind: str):
        known: dict = {}

        def encode_value(v) -> bytes:
            if v is None:
                return b""
            out = known.get(v)
            if out is None:
                out = put(n, kind, v)
                if len(known) < REMEMBERED:
                    known[v] = out
            return out

        return encode_value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [header_encoder(n, kind) for n, _, kind in headers] + [field_encoder(k, *v) for k, v in fields.items()]
        starts = [bytes([RECORD, len(x) + 1, LENGTH_TAG]) + x + bytes([UNIT]) for x in map(put_varint, range(1024))]
        for batch in batches:
            columns = [list(map(e, c.to_pylist())) for e, c in zip(encoders, batch.columns, strict=True)]
            payloads = map(b"".join, zip(*columns, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([starts[len(p)] + p if len(p) < 1024 else frame(p) for p in payloads], pa.binary())], ["frame"])

    return messages.select(*[name for _, name, _ in headers], *fields).mapInArrow(run, "frame binary")


def write_tsv(report: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """A report as one tab-separated file with a header."""
    report.toDF(*columns).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def write_plugins(report: DataFrame, path: str) -> None:
    write_tsv(report, path, PLUGIN_COLUMNS)


def write_utilization(report: DataFrame, path: str) -> None:
    write_tsv(report, path, UTILIZATION_COLUMNS)


def write_checkpoints(checkpoints: DataFrame, path: str) -> None:
    text_lines(checkpoints).coalesce(1).write.mode("overwrite").text(path)


def termination_records(errors: DataFrame) -> DataFrame:
    """(plugin, value) from plugin, at_us, error: ``time TAB error``."""
    return errors.select("plugin", F.concat(utc_second(F.col("at_us")), F.lit("\t"), "error").alias("value"))
