"""Token-ID output: Parquet files with list columns of token ids, sized and encoded for selective reads.

Format. A folder of Parquet files in ascending order of document and file name, one row a document: ``doc_id``, ``n_tokens``, ``ids`` (list of
int, the last one the end id), and its place: ``file_range`` and ``row``. Written with the version 2 writer: ``doc_id`` and ``n_tokens`` (no dictionary) get
delta encoding, the ids a dictionary while it is small and delta encoding beyond it, then zstd. Row groups and pages are small
(parameters below), with page indexes, so a reader of some documents or of metadata alone skips the other pages.

Encoding. Words repeat, and nothing in the tokenizer crosses ASCII white space: a worker remembers the ids of each
chunk that the library has encoded and asks the library only for new ones.

Order. Text is dealt once by ranges of (id, hash of text, place in the input), which Spark takes from a sample, and sorted in each; so rows that share an id, or have none, are many
ranges too. Files carry the number of their range, and rows their number in it, in the order they are written. A document's start is the sum over the ranges before its own plus
the sum within: no task sees more than one range.

Defined cases. Null text: as empty, the end id alone. Null id: first. Repeated ids: in order of their texts' hashes; equal rows in any order. Very long texts: one pass. Ids that
aren't whole numbers are refused. Empty table: empty result, no files. Other columns aren't read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, whole_number

KNOWN_CHUNKS, LONG = 800_000, 48
STOP = re.compile(rb"([.,])(?<=[a-z0-9][.,])(?=\s|$)")  # the stop first: the search then skips to one
ROW_GROUP, PAGE = 8 << 20, 64 << 10
TOKENS = "doc_id long, n_tokens long, ids array<int>, file_range long, row long"
NAMES = ["doc_id", "n_tokens", "ids", "file_range", "row"]


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def chunks(self, text: str) -> list[bytes]:
        """Parts that the tokenizer encodes independently of each other: at white space, and before a comma or stop that ends a word."""
        data = text.encode()
        if b"<|" not in data:  # a special string in capitals must stay ordinary text; else case goes anyway
            data = STOP.sub(rb" \1", data.lower())
        return data.split()

    def ask(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks from the library. Chunks in Latin-1, whose letters it maps one to one, go as one text with spaces between, and its offsets tell whose a token is."""
        plain, others, ends, at = [], [], [], 0
        for c in chunks:
            text = c.decode()
            if len(text) > 1000 or "<|" in text or not text.isascii() and max(text) > "\xff":
                others.append(text)
            else:
                at += len(text) + 1
                ends.append(at)
                plain.append(c)
        out = {t.encode(): np.array(e.ids, "<u4").tobytes() for t, e in zip(others, self.library.encode_batch(others, add_special_tokens=False), strict=True)}
        if plain:
            e = self.library.encode(b" ".join(plain).decode(), add_special_tokens=False)
            ids, starts = np.array(e.ids, "<u4"), np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            cuts = [0, *(4 * np.searchsorted(starts, np.array(ends))).tolist()]
            data = ids.tobytes()
            out |= {c: data[x:y] for c, x, y in zip(plain, cuts[:-1], cuts[1:], strict=True)}
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        chunks = [self.chunks(t) for t in texts]
        found = self.ask(list(set().union(*chunks).difference(self.known)))
        if len(self.known) + len(found) > KNOWN_CHUNKS:
            self.known = {c: self.known[c] for x in chunks for c in x if c in self.known}
        self.known |= found
        out = [b"".join(map(self.known.__getitem__, x)) for x in chunks]
        for c in found:
            if len(c) > LONG:
                del self.known[c]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int | None = 2) -> None:
    """Encode every text and write the files to ``folder``."""
    last = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, row = encoder(path), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row += part.num_rows
                parts = [x + last for x in e.texts([t or "" for t in part.column(1).to_pylist()])]
                sizes = np.fromiter((len(x) // 4 for x in parts), np.int64, len(parts))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids, part.column(2), pa.array(np.arange(row - part.num_rows, row))], NAMES)

    slim = docs.select(whole_number(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "__hash", "__place"]
    sorted_ = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    tokens = sorted_.withColumn("file_range", F.spark_partition_id().cast("long")).mapInArrow(run, TOKENS)
    tokens.write.options(**{
        "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.writer.version": "PARQUET_2_0", "compression": "zstd",
        "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.enable.dictionary#row": "false", "parquet.dictionary.page.size": str(1 << 20),
    }).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids, file_range, row) from the files."""
    return spark.read.schema(TOKENS).parquet(folder)


def token_digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read from the files: start counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            data, cuts = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64()), *batch.columns[2:]], ["doc_id", "n_tokens", "ids_crc32", "file_range", "row"])

    # metadata alone first: the column of sizes, without the ids
    sums = read_tokens(spark, folder).groupBy("file_range").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("file_range", F.coalesce(F.sum("n").over(Window.orderBy("file_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = read_tokens(spark, folder).select("doc_id", "ids", "file_range", "row").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, file_range long, row long")
    within = Window.partitionBy("file_range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(before, "file_range").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
