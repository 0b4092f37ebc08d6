"""Queues of files: frames, rolling, positions, gaps, lag and backpressure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import file_id, frame_length
from .running import running


def rolled(messages: DataFrame, limit: int, *, size: Column, pos: str = "pos", by: list[str] | None = None) -> DataFrame:
    """(pos, file_id, offset) of each message in its queue: a file is left after the message that brings it to ``limit`` bytes.

    The overshoot of a file is not carried over, so places can't be had by dividing a running sum. A queue has one writer, and this is its
    sorted pass: positions and sizes only, batch by batch, with two numbers of state; a step for each file, not for each message.
    """
    keys = by or ["queue"]

    def run(batches):
        state: tuple = (None, 0, 0)  # queue, file, bytes in it
        for batch in batches:
            names = list(zip(*[c.to_pylist() for c in batch.columns[:-2]], strict=True))
            sizes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            file_ids, offsets = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                _, id_, off = state if state[0] == names[a] else (names[a], 0, 0)
                ends = np.cumsum(sizes[a:b])  # bytes after each message, from the first one of this stretch on
                start, base = 0, -off  # a file's first message here, and the bytes before the file's beginning
                while start < len(ends):
                    full = int(np.searchsorted(ends, base + limit))  # the message that brings the file to the limit
                    last = min(full + 1, len(ends))
                    file_ids[a + start : a + last] = id_
                    offsets[a + start : a + last] = ends[start:last] - sizes[a + start : a + last] - base
                    if full == len(ends):
                        break
                    start, base, id_ = last, int(ends[full]), id_ + 1
                state = (names[a], id_, int(ends[-1]) - base)
            if names:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(file_ids), pa.array(offsets)], [*keys, "pos", "file_id", "offset"])

    slim = messages.select(*keys, F.col(pos).cast("long").alias("pos"), size.cast("long").alias("size"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name in keys) + ", pos long, file_id long, offset long"
    return slim.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(run, schema)


def framed_size(payload: Column) -> Column:
    return frame_length(F.coalesce(F.octet_length(payload), F.lit(0)).cast("long"))


def after_position(messages: DataFrame, id_: int, offset: int) -> DataFrame:
    """What a reader that stopped at (id, offset) still has to read."""
    return messages.where((F.col("file_id") > id_) | ((F.col("file_id") == id_) & (F.col("offset") >= offset)))


def files(names: DataFrame, name: str = "name") -> DataFrame:
    """(file_id) of the queue files among directory entries."""
    return names.select(file_id(F.col(name)).alias("file_id")).where("file_id is not null")


def first_last(ids: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lowest and highest file: where an ``earliest`` and a ``latest`` reader start, and where a writer goes on."""
    return ids.groupBy(*(by or [])).agg(F.min("file_id").alias("first_id"), F.max("file_id").alias("last_id"), F.count("*").alias("n_files"))


def next_ids(ids: DataFrame, by: list[str] | None = None) -> DataFrame:
    """With ``next_id``, the next file that exists, and ``skipped``, the missing ones before it; null after the last."""
    w = Window.partitionBy(*(by or [])).orderBy("file_id")
    nxt = F.lead("file_id").over(w)
    return ids.select(*(by or []), "file_id", nxt.alias("next_id"), (nxt - F.col("file_id") - 1).alias("skipped"))


def reset_positions(readers: DataFrame, tries: int = 60) -> DataFrame:
    """Readers whose file didn't appear in over ``tries`` tries start again from the writer's end. Columns: reader, file_id, offset, tries, writer_id, writer_offset."""
    lost = F.col("tries") > tries
    return readers.select("reader", F.when(lost, F.col("writer_id")).otherwise(F.col("file_id")).alias("file_id"), F.when(lost, F.col("writer_offset")).otherwise(F.col("offset")).alias("offset"), lost.alias("was_reset"))


def low_water_marks(readers: DataFrame) -> DataFrame:
    """Lowest file that any reader of a queue still reads: (queue, min_id)."""
    return readers.groupBy("queue").agg(F.min("file_id").alias("min_id"))


def over_lag(writer_id: Column, min_id: Column, limit: int) -> Column:
    """Whether readers lie further behind than ``limit`` files (0: no limit)."""
    return F.lit(False) if limit <= 0 else (writer_id - min_id) > limit


def over_disk(free: Column, limit: int) -> Column:
    """Whether no more than ``limit`` files fit on the disk (0: no limit)."""
    return F.lit(False) if limit <= 0 else free <= limit


def backpressure(steps: DataFrame, lag: int, disk: int = 4) -> DataFrame:
    """With ``throttled`` after each step of a queue. Columns: queue, step, kind (``roll`` or ``check``), writer_id, min_id, free.

    A roll turns it on when readers lag or the disk fills; a check turns it off only when readers have caught up and the disk has room.
    """
    rises = over_lag(F.col("writer_id"), F.col("min_id"), lag) | over_disk(F.col("free"), disk)
    calm = (F.col("writer_id") == F.col("min_id")) & (F.lit(True) if disk <= 0 else F.col("free") > disk)
    # what turns it last decides; all other steps leave it as it is
    turn = F.when((F.col("kind") == "roll") & rises, True).when((F.col("kind") != "roll") & calm, False)
    rows = running(steps, F.when(turn.isNotNull(), F.struct(F.col("step").alias("at"), turn.alias("on"))), "__turn", pos="step", by=["queue"], fold="max")
    return rows.select("queue", F.col("step").cast("long").alias("step"), F.coalesce(F.col("__turn")["on"], F.lit(False)).alias("throttled"))


def throttled_rate(delay_ms: int = 100) -> int:
    """Messages a second that one throttled producer may inject: a source's admission limit."""
    return 1000 // delay_ms
