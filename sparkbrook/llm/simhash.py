"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees within a Hamming radius.

Fingerprint. A-Z lower-cased, words by ASCII white space, shingles of ``words`` words with repeats, XXH64 (seed 42) of each; a
bit is 1 if it is set in over half of the hashes. Fewer words: the whole sequence is the shingle; none: fingerprint zero.

Linking. Equal fingerprints are one node (smallest id). The 64 bits are cut into ``blocks`` blocks; two fingerprints within
radius r agree in at least blocks - r of them, so every combination of that many blocks is a shard key, and every link
lies in at least one shard. Each shard has its BK-trees (``bk_trees``). Components of the forest of links are found by alternating
large-star and small-star steps on DataFrames.

Defined cases. Null, empty and blank texts: fingerprint zero, linked like others. Very long texts: one pass, 255 hashes a sum. Repeated rows: one row each
out. A null id is a row with its own fingerprint and the component of that fingerprint. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bk_trees import BLOCK, components, links
from .common import whole_number, written

SEED = 42
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, in order and with repeats; empty for a text without words."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    digest, line = xxhash.xxh64_intdigest, b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([digest(line, SEED)] if tokens else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[: len(tokens) - words] + 1).tolist()]
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (rows of 64-bit words) have each bit set, lowest bit first: counts stand in the bytes of words, up to 255 rows at a time."""
    rows = hashes.reshape(len(hashes), -1)
    cuts = np.arange(0, len(rows), 255)
    out = np.empty((rows.shape[1], 8, 8), np.int64)  # word, byte, bit
    for bit in range(8):
        lanes = np.add.reduceat(rows >> np.uint64(bit) & _ONES, cuts, axis=0)
        out[:, :, bit] = lanes.view(np.uint8).reshape(len(cuts), rows.shape[1], 8).sum(axis=0, dtype=np.int64)
    return out.reshape(-1)


def fingerprint(text: str | None, words: int = 3) -> int:
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    return int.from_bytes(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): a signed 64-bit fingerprint for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(whole_number(docs, id_col).alias("id"), text_col).mapInArrow(run, "id long, fp long")


def block_keys(fp: str, radius: int, blocks: int):
    """Shard keys of a fingerprint: every choice of blocks - radius of its blocks, hashed with the choice's number."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in c) for c in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(k), F.col(fp).bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, radius: int = 3, blocks: int = 5, block: int = BLOCK) -> DataFrame:
    """(id, fp, component): a row for each document, with the smallest id that links reach from its fingerprint."""
    prints = written(fingerprints(docs, id_col, text_col, words), "simhash")
    named = written(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "simhash-nodes")
    joined = components(links(named.select("node", block_keys("fp", radius, blocks).alias("keys"), F.col("fp").alias("w0")), radius, block=block))
    of = named.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    # a fingerprint that many rows share is a hot key of this join: it is salted
    salts = 16
    return (
        prints.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .join(of.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["fp", "salt"], "left")
        .select("id", "fp", "component")
    )
