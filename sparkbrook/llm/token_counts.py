"""Token counts by prefix dynamic programming: the exact number of tokens of every prefix of a text.

Byte-level BPE encodes every prefix of a pre-token so that its last token is fixed by a local rule: among the tokens that end
there, it is the one whose own predecessor may stand before it (merging the two's bytes gives just these two tokens). So
count(prefix) = count(prefix without its last token) + 1, a table filled once from left to right. Workers remember words.

The pre-tokens of a text follow each other, and the count at a prefix of the text is the sum over whole pre-tokens plus
the count within the one that it cuts. Where a cut changes how the text splits (inside white space, a contraction, or a special
string), the counts are those of the cut text itself. Counts are kept as one signed byte a code point: the difference to the
prefix before.

Defined cases. Null text: as the empty text, 0 tokens. Very long pre-tokens: worked out in one pass and not remembered.
Repeated rows: one row each out. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The split pattern of byte-level BPE files of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts in Latin-1, with its classes spelled out and its commonest branch first.
SPLIT_LATIN = (
    r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
#: Pre-tokens that a worker remembers at most, and the letters of the longest that it does remember.
KNOWN_WORDS, LONG = 700_000, 48
NEVER = 1 << 40
SPACE = regex.compile(r"\s+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if it is printable in Latin-1, else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def newer() -> Callable[[str], object]:
    """Finds letters and numbers that the regex module knows but Python's tables don't: whether the tokenizers library knows them is for it to say."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    return regex.compile("[" + "".join(f"{regex.escape(g[0])}-{regex.escape(g[-1])}" for g in runs(new)) + "]" if new else "(?!)").search


def runs(chars: list[str]) -> list[str]:
    """Stretches of neighbouring code points."""
    out: list[str] = []
    for c in chars:
        if out and ord(c) == ord(out[-1][-1]) + 1:
            out[-1] += c
        else:
            out.append(c)
    return out


class PrefixTable:
    """Counts at every prefix, for one vocabulary file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        vocab = model["vocab"]
        number = {t: i for i, t in enumerate(t for t in vocab if len(t) == 1)}
        self.ranks: dict[int, int] = {}  # left << 20 | right -> rank of their merge
        self.parts: list[tuple[int, int] | None] = [None] * len(number)
        for (a, b), i in rank.items():
            if a + b not in number:
                number[a + b] = len(number)
                self.parts.append((number[a], number[b]))
            self.ranks[number[a] << 20 | number[b]] = i
        self.edges: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
        self.ids = {as_bytes(t): n for t, n in number.items()}
        # lengths of the tokens that end in these three bytes, longest first; shorter ones may always end there
        ends: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                ends.setdefault(t[-3:], {1, 2}).add(len(t))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split, self.split_latin = regex.compile(SPLIT).findall, re.compile(SPLIT_LATIN).findall
        self.path = path
        self.pairs: dict[int, bool] = {}
        self.fixed: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        for tail in ("re", "ve", "ll"):  # cut after its first letter, a contraction is an apostrophe and a word
            whole = self._counts(f"'{tail}")
            self.fixed[f"'{tail}"] = self._deltas([whole[0], self._counts("'")[-1] + self._counts(tail[0])[-1], whole[-1]])

    def _edge(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """What stands at the left and at the right edge of a token while its bytes are merged: pieces, each with the rank of the merge that ends it, the token itself never."""
        found = self.edges.get(token)
        if found is None:
            found = ([(token, NEVER)], [(token, NEVER)])
            for side, pieces in enumerate(found):
                while (parts := self.parts[pieces[-1][0]]) is not None:
                    pieces.append((parts[side], self.ranks[parts[0] << 20 | parts[1]]))
            self.edges[token] = found
        return found

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a, b gives a, b: no two pieces that meet at their border merge before one of them is merged away from it.

        A pair's merge comes after those that made its pieces, so ranks are times. Merges of one rank go from left to right: a piece of ``a`` that is merged to its left at
        the very rank is gone, one of ``b`` that would be merged to its right isn't yet.
        """
        ranks = self.ranks.get
        for x, x_ends in self._edge(a)[1]:
            for y, y_ends in self._edge(b)[0]:
                r = ranks(x << 20 | y)
                if r is not None and r < x_ends and r <= y_ends:
                    return False
        return True

    def _table(self, data: bytes) -> list[int]:
        """The count at every byte prefix, the empty one first."""
        ids, sizes, pairs = self.ids.get, self.sizes.get, self.pairs
        counts, lasts = [0], [-1]
        for end in range(1, len(data) + 1):
            for size in sizes(data[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                if size > end:
                    continue
                token = ids(data[end - size : end])
                if token is None:
                    continue
                if size == end:
                    break
                last = lasts[end - size]
                key = last << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= KNOWN_WORDS:
                        pairs.clear()
                    fits = pairs[key] = self._may_follow(last, token)
                if fits:
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            counts.append(counts[end - size] + 1)
            lasts.append(token)
        return counts

    def _counts(self, word: str) -> list[int]:
        """The count at every code point of a pre-token."""
        data = word.encode()
        counts = self._table(data)
        if len(data) == len(word):
            return counts[1:]
        return [counts[end] for end in accumulate(len(c.encode()) for c in word)]

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _deltas(counts: list[int]) -> bytes:
        """Differences of counts as signed bytes; for a letter they lie between -128 and 127, being its bytes at most."""
        return bytes([x - y & 255 for x, y in zip(counts, [0, *counts[:-1]], strict=True)])

    def word(self, word: str) -> bytes:
        """Deltas of a pre-token, remembered."""
        found = self.known.get(word)
        if found is None:
            found = self.fixed.get(word) or self._deltas(self._counts(word))
            if len(word) <= LONG:
                if len(self.known) >= KNOWN_WORDS:
                    self.known.clear()
                self.known[word] = found
        return found

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if newer()(text):
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            return self.split(text)
        return self.split_latin(text)

    def segments(self, text: str) -> list[str]:
        """Text and special strings in turn."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return [text]
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += [text[at : m.start()], m[0]]
            at = m.end()
        return [*out, text[at:]]

    def count(self, text: str) -> int:
        return sum_of(self.deltas(text))

    def deltas(self, text: str) -> bytes:
        """One signed byte a code point: the exact count up to it, less the count up to the one before."""
        parts = self.segments(text)
        out = []
        for i in range(0, len(parts), 2):
            if i + 1 == len(parts):
                out.append(self._plain(self.words(parts[i])))
                continue
            open_ = self._plain(self.words(parts[i] + parts[i + 1][:-1]))  # until its last letter, a special string is ordinary text
            out += [open_, np.array([self.count(parts[i]) + 1 - sum_of(open_)], np.int8).tobytes()]
        return b"".join(out)

    def _plain(self, words: list[str]) -> bytes:
        try:
            out = list(map(self.known.__getitem__, words))
        except KeyError:
            out = list(map(self.word, words))
        # A cut within the white space that begins a pre-token lengthens the white space before it.
        owed, done = 0, 0  # owed: what the count at the last letter lacks because cutting there splits the text otherwise
        for after in [i for i, word in enumerate(words, 1) if word.isspace()]:
            i = max(after, done)
            while i < len(words) and (owed or i == after and words[i][0].isspace() and SPACE.fullmatch(words[i - 1] + words[i][0])):
                counts = np.cumsum(np.frombuffer(out[i], np.int8), dtype=np.int64)
                total, start = counts[-1], -owed
                if not owed:
                    # cut at the end of the white space, all of it is one pre-token
                    counts[0] = sum_of(self.word(words[i - 1] + words[i][0])) - sum_of(self.word(words[i - 1]))
                out[i] = np.diff(np.concatenate(([start], counts))).astype(np.int8).tobytes()
                owed = int(total - counts[-1])
                i = done = i + 1
        return b"".join(out)


def sum_of(deltas: bytes) -> int:
    return int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64))


def longest_within(deltas: bytes, limit: int) -> int:
    """Code points of the longest prefix with at most ``limit`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64) <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


NAMES = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_deltas"]
_tables: dict[str, PrefixTable] = {}


def table(path: str) -> PrefixTable:
    """One table a worker and file."""
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars, prefix_deltas) for each row.

    prefix_deltas: the exact count at every prefix, as differences, one signed byte a code point; ``prefix_counts`` and ``longest_within`` read them, so that later questions of
    budget and truncation need no encoding. fit_chars: code points of the longest prefix within ``limit`` tokens. All are read off the same differences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [x or "" for x in part.column(1).to_pylist()]
                deltas = [t.deltas(x) for x in texts]
                counts = np.fromiter(map(sum_of, deltas), np.int64, len(deltas))
                fits = [len(d) if n <= limit else longest_within(d, limit) for d, n in zip(deltas, counts, strict=True)]
                sizes = pa.array([len(x.encode()) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(counts), pa.array(counts > limit), pa.array(fits, pa.int64()), pa.array(deltas, pa.binary())], NAMES)

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_deltas binary")


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Tokens of every prefix, from one code point on."""
    return np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)


def within_budget(counted: DataFrame, limit: int) -> DataFrame:
    """(doc_id, fit_chars) of stored counts for another limit: no text, no encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([longest_within(d.as_py(), limit) for d in batch.column(1)], pa.int64())], ["doc_id", "fit_chars"])

    return counted.select("doc_id", "prefix_deltas").mapInArrow(run, f"doc_id {counted.schema['doc_id'].dataType.simpleString()}, fit_chars long")
