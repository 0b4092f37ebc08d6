"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

Fingerprint. A rolling hash over a window of seven bytes picks boundaries: at block size b (a power of two) a chunk ends
where the hash's low bits are all ones. Every chunk gives one letter of 64 by its checksum. The block size is the smallest
(4 at least) that gives at most 64 chunks, so no text is cut off; the fingerprint is ``b:letters at b:letters at 2b``.

Likeness. Letters are compared at block sizes that both fingerprints have: 1 - (insertions + deletions) / letters, the best of
what can be compared; 0 if there is none, or if the two have no run of four letters in common (shorter ones: none at all).

Next document. Documents stand in order of a key: descending id, nulls last, then the hash of the text. A first pass sorts keys alone, by Spark's ranges, and gives every
``RANGE_ROWS``-th one: the heads of as many ranges (``RANGES`` and one for each sorted part at most, 17 bytes each, on the driver and in the tasks). A range is dealt to a task with
one guest, the head of the next range; text moves once and no task holds more than its range.

Defined cases. Null text: as empty; the fingerprint of the empty text is ``4::``. Equal texts have equal fingerprints and
likeness 1. Null ids come last. Equal ids stand in order of their texts' hashes. Rows equal in id and text stay in one range. One document alone is its own next. Very long texts:
one pass. Ids that aren't whole numbers are refused. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_number

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LEAST, CHUNKS, RUN = 7, 4, 64, 4
#: Documents to a range, about, and ranges at most (below that many, and one more for each sorted part).
RANGE_ROWS, RANGES = 250, 65_536
#: Keys, of 16 bytes, to a task that sorts them.
PART_ROWS = 200_000


def rolling(data: bytes) -> np.ndarray:
    """The hash of the (up to) seven bytes that end at each byte."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    h = b * np.uint32(2654435761)
    for k in range(1, min(WINDOW, len(b))):
        h[k:] += b[:-k] * np.uint32((2654435761 * pow(40503, k, 1 << 32)) % (1 << 32) | 1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    h ^= h >> np.uint32(13)
    return h


def letters(data: bytes, ends: np.ndarray) -> str:
    cuts = [0, *ends.tolist()]
    if cuts[-1] != len(data):
        cuts.append(len(data))
    return "".join(LETTERS[zlib.crc32(data[a:b]) & 63] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def fingerprint(text: str) -> str:
    data = text.encode()
    if not data:
        return f"{LEAST}::"
    h = rolling(data)
    size, ends = LEAST, np.flatnonzero((h & np.uint32(LEAST - 1)) == LEAST - 1)
    low = h[ends]
    while len(ends) >= CHUNKS:
        size *= 2
        keep = (low & np.uint32(size - 1)) == size - 1
        ends, low = ends[keep], low[keep]
    wider = ends[(low & np.uint32(2 * size - 1)) == 2 * size - 1]
    return f"{size}:{letters(data, ends + 1)}:{letters(data, wider + 1)}"


def common_run(a: str, b: str) -> bool:
    if min(len(a), len(b)) < RUN:
        return True
    runs = {a[i : i + RUN] for i in range(len(a) - RUN + 1)}
    return any(b[i : i + RUN] in runs for i in range(len(b) - RUN + 1))


def likeness_of_letters(a: str, b: str) -> float:
    """1 - (insertions + deletions that make b of a) / letters of both, by the longest common subsequence in bits."""
    if a == b:
        return 1.0
    if not a or not b or not common_run(a, b):
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1, for two fingerprints."""
    if x == y:
        return 1.0
    xs, x1, x2 = x.split(":")
    ys, y1, y2 = y.split(":")
    mine, other = {int(xs): x1, 2 * int(xs): x2}, {int(ys): y1, 2 * int(ys): y2}
    return max((likeness_of_letters(mine[k], other[k]) for k in mine.keys() & other.keys()), default=0.0)


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def order_keys(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    """Keys as bytes that sort like (nulls last, descending id, hash)."""
    out = np.zeros(len(ids), np.dtype([("null", "u1"), ("id", ">u8"), ("hash", ">u8"), ("end", "u1")]))  # the end byte keeps numpy from cutting zeros off
    sign = np.uint64(1 << 63)
    out["null"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["id"] = ~(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ sign)
    out["hash"] = hashes.to_numpy(zero_copy_only=False).view(np.uint64) ^ sign
    out["end"] = 1
    return out.view("S18")


def range_heads(docs: DataFrame, range_rows: int, ranges: int) -> np.ndarray:
    """The key of every so many-th document, and of the first one of each sorted part, in order."""
    n = docs.count()
    rows = max(range_rows, -(-n // ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            picked = np.arange(-seen % rows, batch.num_rows, rows)
            seen += batch.num_rows
            if len(picked):
                part = batch.take(pa.array(picked))
                yield pa.RecordBatch.from_arrays([pa.array(order_keys(part.column(0), part.column(1)).tolist(), pa.binary())], ["key"])

    order = [F.col("doc_id").desc_nulls_last(), "hash"]
    keys = docs.select("doc_id", "hash").repartitionByRange(1 + n // PART_ROWS, *order).sortWithinPartitions(*order).mapInArrow(run, "key binary")
    return np.unique(np.array([bytes(r[0]) for r in keys.collect()], "S18"))


def with_ranges(docs: DataFrame, range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, text, range, guest) dealt by range and sorted; ``guest`` rows are the first documents after their range."""
    docs = docs.withColumn("hash", F.xxhash64("text"))
    heads = range_heads(docs, range_rows, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = order_keys(batch.column(0), batch.column(2))
            own = np.searchsorted(heads, keys, side="right") - 1
            visits = np.flatnonzero(heads[own] == keys)  # a head is also the guest of the range before it, the first one of the last
            rows = np.concatenate((np.arange(len(keys)), visits))
            seat = np.concatenate((own, (own[visits] - 1) % len(heads)))
            guest = (np.arange(len(rows)) >= len(keys)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(seat), pa.array(guest)], ["doc_id", "text", "hash", "range", "guest"])

    seated = docs.mapInArrow(run, "doc_id long, text string, hash long, range long, guest int")
    dealt = seated.repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "hash", "text")
    return dealt.select("doc_id", "text", "range", "guest")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pair(doc: tuple, after: tuple) -> tuple:
        text, mark = doc[1], doc[2]
        other = edited(text, after[1])
        mark2 = fingerprint(other)
        return doc[0], len(text), hashlib.sha256(other.encode()).hexdigest(), mark, mark2, likeness(mark, mark2), likeness(mark, after[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document before, which waits for its next
        for batch in batches:
            out = []
            for i, t, r, guest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held is None and guest:
                    continue  # more guests than one, of equal ids: the first was met
                text = t.as_py()
                now = (i, text, fingerprint(text), r)
                if held is not None:
                    if held[3] != r:
                        raise RuntimeError("a range has no guest")
                    out.append(pair(held, now))
                held = None if guest else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), types, strict=True)], names)
        if held is not None:
            raise RuntimeError("a range has no guest")

    slim = docs.select(whole_number(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_ranges(slim, range_rows).mapInArrow(run, schema)
