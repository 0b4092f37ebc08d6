"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding. Byte-pair merging by an agenda: all adjacent pairs whose join is a piece wait in a heap by score, then from left to right; the best is
merged, and its new neighbours enter. With dropout, each candidate that comes up is skipped if a keyed hash of (seed, document, place, merge) falls
below the rate: every candidate at every place of every document is drawn for itself, and the same in every run. What no piece covers becomes byte pieces, and so does
the letter U+2581, which stands for the space: every segmentation decodes to the very text.

No piece of such a model has a space after another letter, and none has a line feed, so text is cut there into chunks that don't
affect each other; where no piece holds a letter and a stop after it, text is cut between these too. A worker remembers, per chunk, the segmentation without skips and the
candidates that came up on the way. An occurrence where none of these is skipped takes it; all other occurrences of a batch are merged each for itself, in step, by arrays: in every
step each takes its best candidate, draws it, and merges it or lets it lie.

At rate 0 the result is that of the sentencepiece library (but for texts with U+2581). Defined cases. Null text: as empty, no ids. Null id: a key like
others. Very long texts: one pass; long chunks aren't remembered and use a heap as agenda. Rows of one id that follow each other, as a mix emits them: each draws for itself, by its number in the row. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered

RATE, SEED = 0.1, 5
KNOWN_CHUNKS, LONG, ROWS = 700_000, 48, 4_096
#: Cut before these where they follow a letter, if no piece of the model holds a letter followed by one of them.
STOPS = ".,;:!?)\"'|"
CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
CHUNK_AT_STOPS = re.compile(rf"\n| *[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{re.escape(STOPS)}])| +[^ \n]*|[^ \n]+")
SPACE = "▁"
MASK, NONE = 2**64 - 1, np.int32(2**31 - 1)
MIX_A, MIX_B = 0xD6E8FEB86659FD93, 0xA24BAED4963EE407


def pack(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PairTable:
    """Rank of the merge of two pieces, by their numbers: a hash table in arrays, looked up many pairs at a time."""

    BITS, EMPTY, FACTOR = 20, -(1 << 62), np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: dict[int, int]):
        while len(pairs) << 1 > 1 << self.BITS:
            self.BITS += 1
        self.keys, self.ranks = np.full(1 << self.BITS, self.EMPTY, np.int64), np.full(1 << self.BITS, NONE, np.int32)
        for key, slot in zip(pairs, self.slots(np.fromiter(pairs, np.int64, len(pairs))).tolist(), strict=True):
            while self.keys[slot] != self.EMPTY:
                slot = slot + 1 & (1 << self.BITS) - 1
            self.keys[slot], self.ranks[slot] = key, pairs[key]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self.FACTOR >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the two don't merge; a piece below zero merges with none."""
        keys = left.astype(np.int64) << 24 | right
        slots = self.slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.ranks[slots], NONE)
        todo = np.nonzero((there != keys) & (there != self.EMPTY))
        while len(todo[0]):
            slots[todo] = slots[todo] + 1 & (1 << self.BITS) - 1
            there = self.keys[slots[todo]]
            found = there == keys[todo]
            out[tuple(x[found] for x in todo)] = self.ranks[slots[todo][found]]
            todo = tuple(x[~found & (there != self.EMPTY)] for x in todo)
        return out


def merge_key(place: int, left: int, joined: int) -> int:
    """A candidate within its chunk: where it starts, the length of its left piece and of both."""
    return place << 16 | left << 8 | joined


def skipped_at(base: int, merge: int, below: int) -> bool:
    """Whether dropout skips ``merge`` in the chunk whose occurrence has the key ``base``."""
    x = (base ^ merge) * MIX_A & MASK
    return (x ^ x >> 32) * MIX_B & MASK < below


def skips(bases: np.ndarray, merges: np.ndarray, below: int) -> np.ndarray:
    """The same for arrays."""
    x = (bases ^ merges) * np.uint64(MIX_A)
    x ^= x >> np.uint64(32)
    x *= np.uint64(MIX_B)
    return x < np.uint64(below)


class Pieces:
    """A BPE model with byte fallback, as the sentencepiece library stores it."""

    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.ranks: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.text.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.ids[piece], self.ranks[piece] = i, -model.get_score(i)
                self.text.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("a piece crosses a space or a line")
        self.size = model.vocab_size()
        scores = sorted(set(self.ranks.values()))
        place = {r: k for k, r in enumerate(scores)}
        self.piece_of_rank = np.full(len(scores), -1, np.int32)  # -1: pieces of one score, as runs of spaces have
        alone = Counter(self.ranks.values())
        for p, i in self.ids.items():
            if alone[self.ranks[p]] == 1:
                self.piece_of_rank[place[self.ranks[p]]] = i
        numbers = dict(self.ids)  # letters that only stand within pieces are numbered after them
        for letter in sorted({c for p in self.ids for c in p} - set(self.ids)):
            numbers[letter] = self.size + len(numbers)
        splits = [(numbers[p[:k]] << 24 | numbers[p[k:]], p) for p in self.ids for k in range(1, len(p)) if p[:k] in numbers and p[k:] in numbers]
        self.pairs = PairTable({key: place[self.ranks[p]] for key, p in splits})
        self.joined = PairTable({key: self.ids[p] for key, p in splits if alone[self.ranks[p]] > 1})
        self.letters = np.full(0x110000, -1, np.int32)
        for letter, i in numbers.items():
            if len(letter) == 1:
                self.letters[ord(letter)] = i
        self.letters[ord(" ")] = self.letters[ord(SPACE)]
        at_stops = not any(x.isalpha() and y in STOPS for p in self.ids for x, y in zip(p[:-1], p[1:], strict=True))
        self.chunks = (CHUNK_AT_STOPS if at_stops else CHUNK).findall
        self.seed, self.rate_below = seed, min(round(rate * 2**64), MASK)
        self.forget()

    def bases(self, n: int, key: int) -> np.ndarray:
        """Keys of the chunks 0..n-1 of the document with ``key``."""
        x = np.arange(n, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 + self.seed * 0xD1342543DE82EF95 & MASK)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x

    def forget(self) -> None:
        """Nothing remembered. Chunks are numbers into lists of bytes: a million small objects would keep Python's garbage collector busy."""
        self.known: dict[str, int] = {}
        self.known_ids: list[bytes] = [b""]
        self.known_came: list[bytes] = [b""]

    def merged(self, chunks: list[str], bases: np.ndarray | None = None) -> tuple[list[bytes], list[bytes]]:
        """Ids of chunks of LONG letters at most without U+2581, whose occurrences have the keys ``bases`` (None: without skips), and the candidates that were merged."""
        ids, came = [b""] * len(chunks), [b""] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            for k, x, y in zip(rows.tolist(), *self._merged_in_step([chunks[k] for k in rows.tolist()], sizes[rows], None if bases is None else bases[rows]), strict=True):
                ids[k], came[k] = x, y
        return ids, came

    def _merged_in_step(self, chunks: list[str], sizes: np.ndarray, bases: np.ndarray | None) -> tuple[list[bytes], list[bytes]]:
        # A row a chunk, a column a letter, and one more column that merges with nothing: where a piece begins stand its number, the rank of its pair with the next one, and the
        # places of the pieces after and before it.
        m, width = len(chunks), int(sizes.max())
        starts = np.arange(width) < sizes[:, None]
        piece = np.full((m, width + 1), -1, np.int32)
        piece[:, :width][starts] = self.letters[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        rank = np.full((m, width + 1), NONE, np.int32)
        rank[:, :width] = self.pairs(piece[:, :width], piece[:, 1:])
        after = np.repeat(np.arange(1, width + 2, dtype=np.int32)[None, :], m, axis=0)
        before = np.repeat(np.arange(-1, width, dtype=np.int32)[None, :], m, axis=0)
        row, steps = np.arange(m), []
        while len(row):
            at = rank[row].argmin(axis=1)
            best = rank[row, at]
            live = best != NONE
            row, at, best = row[live], at[live], best[live]
            right = after[row, at]
            end = after[row, right]
            merge = at << 16 | right - at << 8 | end - at  # as merge_key()
            r = row
            if bases is None:
                steps.append((row, merge))
            else:
                gone = skips(bases[row], merge.astype(np.uint64), self.rate_below)
                rank[row[gone], at[gone]] = NONE
                r, at, best, right, end = (x[~gone] for x in (row, at, best, right, end))
            both = self.piece_of_rank[best]
            tied = np.flatnonzero(both < 0)
            both[tied] = self.joined(piece[r[tied], at[tied]], piece[r[tied], right[tied]])
            piece[r, at] = both
            starts[r, right] = False
            rank[r, right] = NONE
            after[r, at] = end
            before[r, end] = at
            rank[r, at] = self.pairs(piece[r, at], piece[r, end])
            left = before[r, at]
            rank[r, left] = self.pairs(piece[r, left], piece[r, at])
        found = piece[:, :width][starts]
        counts = starts.sum(axis=1)
        data, cuts = found.astype("<u4").tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
        ids = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in np.unique(np.repeat(np.arange(m), counts)[(found < 0) | (found >= self.size)]).tolist():  # letters that no piece covers
            places = [*np.flatnonzero(starts[k]).tolist(), len(chunks[k])]
            ids[k] = pack(*self.ids_of([chunks[k][a:b].replace(" ", SPACE) for a, b in zip(places[:-1], places[1:], strict=True)]))
        if bases is not None:
            return ids, [b""] * m
        of, merges = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.empty(0, np.int64),) * 2
        order = np.argsort(of, kind="stable")
        data, cuts = merges[order].astype("<u4").tobytes(), [0, *(4 * np.cumsum(np.bincount(of, minlength=m))).tolist()]
        return ids, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def segment(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids of a chunk without skips, and the candidates that were merged."""
        ids, came = self.merged([chunk])
        return np.frombuffer(ids[0], "<u4").tolist(), np.frombuffer(came[0], "<u4").tolist()

    def ids_of(self, pieces: list[str | None]) -> list[int]:
        """Ids of pieces (None: none); what isn't a piece goes to bytes, and "" is the letter U+2581."""
        out: list[int] = []
        for piece in pieces:
            if piece is not None:
                i = self.ids.get(piece)
                if i is not None:
                    out.append(i)
                else:
                    out += [self.bytes[x] for x in (piece or SPACE).encode()]
        return out

    def segment_long(self, chunk: str, base: int) -> list[int]:
        """Ids of a chunk whose occurrence has the key ``base``, with a heap as agenda: for long chunks and those with U+2581."""
        letters = [SPACE if c == " " else ("" if c == SPACE else c) for c in chunk]  # "" never joins: the letter itself goes to bytes
        n, ranks, below = len(letters), self.ranks, self.rate_below
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            joined = letters[i] + letters[i + 1]
            rank = ranks.get(joined)
            if rank is not None and letters[i] and letters[i + 1]:
                heap.append((rank, i, i + 1, joined))
        heapify(heap)
        while heap:
            _, a, b, joined = heappop(heap)
            # not if the pair has changed since; what was merged into its left neighbour is None and has no place after it
            if after[a] != b or letters[a] + letters[b] != joined:
                continue
            if below and skipped_at(base, merge_key(a, len(letters[a]), len(joined)), below):
                continue
            letters[a], letters[b] = joined, None
            after[a] = c = after[b]
            after[b] = -1
            if c < n:
                before[c] = a
                if letters[c]:
                    more = joined + letters[c]
                    rank = ranks.get(more)
                    if rank is not None:
                        heappush(heap, (rank, a, c, more))
            z = before[a]
            if z >= 0 and letters[z]:
                more = letters[z] + joined
                rank = ranks.get(more)
                if rank is not None:
                    heappush(heap, (rank, z, a, more))
        return self.ids_of(letters)

    def encode(self, text: str, key: int = 0) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return self.encode_many([text], [key])[0]

    def encode_many(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Ids of texts whose documents have ``keys``."""
        parts = [self.chunks(" " + t) if t else [] for t in texts]
        chunks = list(chain.from_iterable(parts))
        bases = np.concatenate([np.empty(0, np.uint64), *(self.bases(len(x), k) for x, k in zip(parts, keys, strict=True))])
        if len(self.known) >= KNOWN_CHUNKS:
            self.forget()
        new = list(set(chunks).difference(self.known))
        special = [c for c in new if len(c) > LONG or SPACE in c]
        if special:
            new = list(set(new).difference(special))
        ids, came = self.merged(new)
        first = len(self.known_ids)
        self.known |= zip(new, range(first, first + len(new)), strict=True)
        self.known_ids += ids
        self.known_came += came
        self.known |= dict.fromkeys(special, 0)  # node 0 has no ids: each of these is merged for itself
        nodes = list(map(self.known.__getitem__, chunks))
        out = list(map(self.known_ids.__getitem__, nodes))
        if special:
            for k in np.flatnonzero(np.array(nodes) == 0).tolist():
                out[k] = pack(*self.segment_long(chunks[k], int(bases[k])))
            for c in special:
                del self.known[c]
        if self.rate_below:
            came = list(map(self.known_came.__getitem__, nodes))
            of = np.repeat(np.arange(len(nodes)), np.fromiter(map(len, came), np.int64, len(came)) // 4)
            hit = np.unique(of[skips(bases[of], np.frombuffer(b"".join(came), "<u4"), self.rate_below)])
            redone, _ = self.merged(list(map(chunks.__getitem__, hit.tolist())), bases[hit])
            for k, x in zip(hit.tolist(), redone, strict=True):
                out[k] = x
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        return [b"".join(out[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of ids: exactly the one that was encoded."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:].decode()


_models: dict[tuple, Pieces] = {}
remembered.append(_models)


def pieces(*settings) -> Pieces:
    if settings not in _models:
        _models[settings] = Pieces(*settings)
    return _models[settings]


def _batches(docs: DataFrame, path: str, id_col: str, text_col: str, rate: float, seed: int, decode: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, last, copy = pieces(path, rate, seed), None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                texts, keys = [t or "" for t in part.column(1).to_pylist()], []
                for key in part.column(2).to_pylist():
                    last, copy = key, copy + 1 if key == last else 0
                    keys.append(key + copy * MIX_A)
                ids = p.encode_many(texts, keys)
                sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
                if decode:
                    same = pa.array([p.decode(x) == t for x, t in zip(ids, texts, strict=True)])
                    yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array([zlib.crc32(x) for x in ids], pa.int64()), same], ["doc_id", "n_tokens", "ids_crc32", "lossless"])
                else:
                    offsets = np.concatenate(([0], np.cumsum(sizes.to_numpy()))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rest = "ids_crc32 long, lossless boolean" if decode else "ids array<int>"
    return docs.select(id_col, text_col, F.xxhash64(id_col).alias("__key")).mapInArrow(run, f"doc_id {kind}, n_tokens long, {rest}")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row."""
    return _batches(docs, path, id_col, text_col, rate, seed, False)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, lossless) for each row: encoded, decoded and compared with the text."""
    return _batches(docs, path, id_col, text_col, rate, seed, True)


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from lists of ids (null: the empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"doc_id {tokens.schema[id_col].dataType.simpleString()}, text string")
