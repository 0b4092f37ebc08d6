"""Queue files (``<id>.log`` of framed messages): batch scan, streaming source with positions, and a writer that rolls.

The batch scan goes through Spark's binary-file reader, so a queue can be in any store; a file is one task's work, which rolling bounds. The
streaming source ``framed`` lists a folder that driver and executors share and gives each file's new part to a task; as a sink, batch or streaming, it appends from all tasks at once.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import MESSAGE
from .codec import decode, encode, frame, frames

NAME = re.compile(r"^(\d+)\.log$")
PLACED = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("skipped", T.LongType()), *MESSAGE.fields, T.StructField("error", T.StringType())])


def _rows(file_id: int, data: bytes, start: int, base: int = 0) -> Iterator[tuple]:
    for offset, skipped, payload in frames(data, start):
        try:
            m, error = decode(payload), None
        except ValueError as e:
            m, error = {}, str(e)
        fields = [tuple(f.values()) for f in m.get("fields") or ()]
        yield (file_id, base + offset, skipped, *[m.get(f.name) for f in MESSAGE.fields[:-1]], fields, error)


def read_queue(spark: SparkSession, folder: str, after: tuple[int, int] = (0, 0)) -> DataFrame:
    """Messages of a queue's files from a position on, with ``file_id``, ``offset``, ``skipped`` (damaged bytes before it) and ``error`` (not a message)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, first = to_arrow_schema(PLACED), after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                todo = []
                for row in _rows(id_, content.as_py(), first[1] if id_ == first[0] else 0):
                    todo.append(row)
                    if len(todo) == 5000:
                        yield _batch(todo, schema)
                        todo = []
                if todo:
                    yield _batch(todo, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder)
    named = files.select(F.regexp_extract("path", r"/(\d+)\.log$", 1).try_cast("long").alias("file_id"), "content").where(F.col("file_id") >= after[0])
    return named.mapInArrow(run, PLACED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = [f.name for f in MESSAGE["fields"].dataType.elementType.fields]
    at = schema.names.index("fields")
    columns[at] = [[dict(zip(names, f, strict=True)) for f in fs] for fs in columns[at]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def queue_ids(folder: str) -> list[int]:
    return sorted(int(m[1]) for n in os.listdir(folder) if (m := NAME.match(n)))


def next_id(ids: list[int], current: int) -> int | None:
    """The smallest file after the current one, across gaps."""
    return min((i for i in ids if i > current), default=None)


class Part(InputPartition):
    def __init__(self, file_id: int, start: int, end: int):
        self.file_id, self.start, self.end = file_id, start, end


class FramedStream(DataSourceStreamReader):
    """Offsets {id, offset} of the last file; new parts of files are read up to their last whole frame."""

    def __init__(self, options: dict):
        self.folder, self.start_at = options["path"], options.get("start", "earliest")
        self.files_a_batch = int(options.get("max_files", "0"))
        self.seen = {"id": -1, "offset": 0}  # up to here the newest file was looked at
        self.taken: int | None = None  # the file that the last batch ended in

    def _end(self) -> dict:
        """The end of what can be read: of the newest file only what was added since the last look is read; with ``max_files``, so many files beyond the last batch at most."""
        ids = queue_ids(self.folder)
        if not ids:
            return {"id": 0, "offset": 0}
        if self.files_a_batch and self.taken is not None:
            within = [i for i in ids if i > self.taken][: self.files_a_batch]
            if within and within[-1] < ids[-1]:
                return {"id": within[-1], "offset": os.path.getsize(f"{self.folder}/{within[-1]}.log")}
        start = self.seen["offset"] if self.seen["id"] == ids[-1] else 0
        self.seen = {"id": ids[-1], "offset": whole_length(f"{self.folder}/{ids[-1]}.log", start)}
        return dict(self.seen)

    def initialOffset(self) -> dict:
        if self.start_at == "latest":
            return self._end()
        ids = queue_ids(self.folder)
        self.taken = ids[0] if ids else 0
        return {"id": self.taken, "offset": 0}

    def latestOffset(self) -> dict:
        return self._end()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out, self.taken = [], end["id"]
        for i in queue_ids(self.folder):
            if start["id"] <= i <= end["id"]:
                a = start["offset"] if i == start["id"] else 0
                b = end["offset"] if i == end["id"] else os.path.getsize(f"{self.folder}/{i}.log")
                if b > a:
                    out.append(Part(i, a, b))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        with open(f"{self.folder}/{partition.file_id}.log", "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        yield from _rows(partition.file_id, data, 0, partition.start)


class FramedBatch(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[Part]:
        return [Part(i, 0, os.path.getsize(f"{self.folder}/{i}.log")) for i in queue_ids(self.folder)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return FramedStream({"path": self.folder}).read(partition)


class FramedSource(DataSource):
    """``spark.readStream.format("framed").option("path", folder)``; options ``start``: earliest or latest, ``max_files``: files a batch at most (0: all)."""

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> T.StructType:
        return PLACED

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FramedBatch(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return FramedStream(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return FramedWriter(self.options)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return FramedStreamWriter(self.options)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[str]


class FramedWriter(DataSourceWriter):
    """Appends to a queue from all tasks at once: each writes frames to files of its own, rolled at ``limit`` bytes, aside in the queue's folder (which all machines share); the commit
    gives them the next numbers, in order of the partitions. A task that fails leaves nothing that a reader sees."""

    def __init__(self, options: dict):
        self.folder, self.limit = options["path"].removeprefix("file://"), int(options.get("limit", 64 << 20))
        self.aside = f"{self.folder}/.pending"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.aside, exist_ok=True)
        files, out, size = [], None, 0
        try:
            for row in iterator:
                if out is None:
                    files.append(f"{self.aside}/{uuid.uuid4().hex}")
                    out, size = open(files[-1], "wb"), 0  # noqa: SIM115
                data = frame(encode(row.asDict(recursive=True)))
                out.write(data)
                size += len(data)
                if size >= self.limit:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written(TaskContext.get().partitionId(), files)

    def commit(self, messages: list) -> None:
        ids = queue_ids(self.folder) if os.path.isdir(self.folder) else []
        free = ids[-1] + 1 if ids else 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for file in m.files:
                os.rename(file, f"{self.folder}/{free}.log")
                free += 1

    def abort(self, messages: list) -> None:
        for m in messages:
            for file in m.files if m is not None else []:
                if os.path.exists(file):
                    os.remove(file)


class FramedStreamWriter(FramedWriter, DataSourceStreamWriter):
    """The same for micro-batches; a batch that was committed before a crash isn't appended again."""

    def commit(self, messages: list, batchId: int) -> None:
        done = f"{self.folder}/.batches"
        os.makedirs(done, exist_ok=True)
        if os.path.exists(f"{done}/{batchId}"):
            return FramedWriter.abort(self, messages)
        FramedWriter.commit(self, messages)
        open(f"{done}/{batchId}", "wb").close()
        return None

    def abort(self, messages: list, batchId: int) -> None:
        FramedWriter.abort(self, messages)


def whole_length(path: str, start: int = 0) -> int:
    """Bytes of a file up to the end of its last whole frame; what lies before ``start``, the end of a frame, isn't read."""
    with open(path, "rb") as f:
        f.seek(start)
        data = f.read()
    end = 0
    for offset, _, payload in frames(data):
        end = offset + len(frame(payload))
    return start + end


class QueueWriter:
    """Appends messages to a queue's newest file and begins a new one after the message that brings it to ``limit`` bytes."""

    def __init__(self, folder: str, limit: int = 64 << 20):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.limit = folder, limit
        ids = queue_ids(folder)
        self.id = ids[-1] if ids else 0
        self.file = open(self._path(), "ab")  # noqa: SIM115

    def _path(self) -> str:
        return f"{self.folder}/{self.id}.log"

    def append(self, payload: bytes) -> tuple[int, int]:
        """The position of the message."""
        at = self.id, self.file.tell()
        self.file.write(frame(payload))
        if self.file.tell() >= self.limit:
            self.file.close()
            self.id += 1
            self.file = open(self._path(), "ab")  # noqa: SIM115
        return at

    def flush(self) -> None:
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()
