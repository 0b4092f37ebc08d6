"""Quality rules and an isolation forest on their statistics.

Statistics of each whole text: words, letters in words, symbol characters, repeated lines, words in repeated three-word
windows. Base rules on these reject a document at once. An isolation forest is fitted on a bounded sample of labelled
documents' statistics (ratios, so long and short texts compare; repeats are left to the base rules): trees of random splits of their rows' ranges over
subsamples of labelled rows, good and bad, where an unusual row is cut off after few splits. Small subsamples keep the bad rows too few to hide each other. The score is 2 ** -(mean path length / expected path length). The threshold is
calibrated on the same labelled rows: the lowest that rejects at most ``MAX_LOSS`` of the good rows which pass the base rules; with no labelled rows of both kinds, the forest rejects nothing.

Only the sample (``SAMPLE_ROWS`` rows of seven numbers at most) comes to the driver, and only the forest goes out. Documents are read twice: once for the texts of the sample,
once to be judged, all of them; texts aren't shuffled.

Defined cases. Null text: no words, so base_failed. Null ids: kept as rows; never labelled. Repeated rows: one row each out. Labels that
disagree on an id: the least counts. Very long texts: one pass. Empty table: empty result. Other columns aren't read by ``judge`` and stay in ``kept_documents``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered

#: Labelled rows that the forest is fitted and calibrated on, at most.
SAMPLE_ROWS = 20_000
TREES, SUBSAMPLE, MAX_LOSS, SEED = 100, 128, 0.002, 11
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SPACES = "\x20\t\n\x0b\x0c\r"


def statistics(text: str) -> tuple[int, ...]:
    """STATS of a text; n_lines: lines with a word, n_distinct: distinct words."""
    words = [w for w in _SPACE.split(text) if w]
    n = len(words)
    if not n:
        return (0, 0, sum(1 for _ in SYMBOLS.finditer(text)), 0, 0, 0, 0)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated = 0
    if n > 3:
        v = len(number)
        if v < 1 << 21:
            keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:  # three numbers don't fit in one: number the pairs first
            keys = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1] * v + ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeated = int(covered.sum())
    return (n, sum(map(len, words)), sum(1 for _ in SYMBOLS.finditer(text)), len(lines) - len(set(lines)), repeated, len(lines), len(number))


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *STATS) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t.as_py() or "") for t in batch.column(1)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(STATS)))], ["doc_id", *STATS])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{s} long" for s in STATS)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def features(stats: np.ndarray) -> np.ndarray:
    """Letters a word, symbols a word, size and variety, from rows of STATS; few symbols differ much from none, so their ratio is on a log scale."""
    n, letters, symbols, _, _, _, distinct = stats.astype(float).T
    some = np.maximum(n, 1)
    return np.column_stack((letters / some, np.log1p(100 * symbols / some), np.log1p(n), np.log1p(distinct) / np.log1p(some)))


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays of nodes: feature (-1: leaf), cut, left child (right is next to it), depth with what a leaf's rows still need."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    size: int
    threshold: float = math.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, left[at] + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
            total += depth[at]
        return 2.0 ** -(total / max(1, len(self.trees)) / max(expected_path(self.size), 1e-9))


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree over a subsample: a node cuts the range of its own rows at random in one of the features that vary there, to the depth of a balanced tree."""
    limit = math.ceil(math.log2(max(2, len(x))))
    feature, cut, left, depth = [-1], [0.0], [0], [0.0]
    todo = [(0, x, 0)]
    while todo:
        at, rows, d = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        wide = np.flatnonzero(high > low)
        if d >= limit or not len(wide):
            depth[at] = d + expected_path(len(rows))
            continue
        f = int(rng.choice(wide))
        c = float(rng.uniform(low[f], high[f]))
        c = c if c > low[f] else float(high[f])  # so that neither side is empty
        feature[at], cut[at], left[at] = f, c, len(feature)
        for side in (rows[rows[:, f] < c], rows[rows[:, f] >= c]):
            todo.append((len(feature), side, d + 1))
            feature.append(-1), cut.append(0.0), left.append(0), depth.append(0.0)
    return np.array(feature), np.array(cut), np.array(left), np.array(depth)


def fit(stats: np.ndarray, good: np.ndarray, *, trees: int = TREES, subsample: int = SUBSAMPLE, max_loss: float = MAX_LOSS, seed: int = SEED) -> Forest:
    """The forest and its threshold, from labelled rows that pass the base rules."""
    passing = ~base_failed(stats[:, 0], stats[:, 4])
    x, good = features(stats[passing]), good[passing]
    rng, size = np.random.default_rng(seed), min(subsample, len(x))
    if size < 2:
        return Forest([], 2)
    forest = Forest([grow(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(trees)], size)
    s = forest.scores(x)
    if good.any() and (~good).any():
        kept = np.sort(s[good])
        forest.threshold = float(kept[min(len(kept) - 1, math.ceil(len(kept) * (1 - max_loss)) - 1)])
    return forest


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and goodness of at most ``rows`` labelled documents, the same ones in every run."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # so it is small enough to broadcast
    met = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    stats = document_statistics(met).join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(rows)
    table = stats.select(*STATS, "quality").toPandas()
    return table[list(STATS)].to_numpy(np.int64).reshape(-1, len(STATS)), table["quality"].to_numpy() == 1


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> Forest:
    """The forest for ``docs``; ``labels``: (doc_id, quality)."""
    return fit(*labelled_sample(docs, labels.select("doc_id", "quality"), id_col, text_col), **settings)


def verdicts(forest: Forest, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of STATS, scores, base_failed and kept."""
    x = np.array([statistics(t.as_py() or "") for t in texts], np.int64).reshape(-1, len(STATS))
    s = forest.scores(features(x)) if forest.trees else np.zeros(len(x))
    failed = base_failed(x[:, 0], x[:, 4])
    return x, s, failed, ~failed & (s <= forest.threshold)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, *STATS, score, base_failed, kept) for each row. ``labels``: (doc_id, quality)."""
    forest = fitted(docs, labels, id_col, text_col, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, s, failed, kept = verdicts(forest, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(len(STATS))), pa.array(s), pa.array(failed), pa.array(kept)], ["doc_id", *STATS, "score", "base_failed", "kept"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{s} long" for s in STATS)
    return docs.select(id_col, text_col).mapInArrow(run, f"{schema}, score double, base_failed boolean, kept boolean")


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows that the rules or the forest reject, in one pass without a shuffle."""
    forest, at, names = fitted(docs, labels, id_col, text_col, **settings), docs.columns.index(text_col), docs.columns
    docs = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(forest, batch.column(at))[3]))

    return docs.mapInArrow(run, docs.schema).toDF(*names)
