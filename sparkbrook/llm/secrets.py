"""Secret scans: known forms, and sliding-window entropy per character class with allow-list suppression.

Known forms (kinds assign, access, hex) are regular expressions with a least length; a match that is too short is dropped and what
it covered isn't searched again for that kind. Kind ``entropy``: candidates are runs of token letters; a window of ``WINDOW``
letters moves over each, its letter counts kept up to date by one addition and one removal a step, and so is the sum of
count * log2(count) that gives Shannon's entropy. A window counts if its entropy passes the bound of its character class
(hex digits; upper- or lower-case letters with digits; letters of both cases and digits; those and signs) and it mixes classes of letters as random
strings do. Bounds lie below nearly all windows of random keys of their class. Windows that touch make one span, and a span grows to the
whole tokens (between the signs + / - _ =) that it touches; spans that a known form covers aren't repeated. The allow-list suppresses runs
(addresses, paths, words joined by signs), and UUIDs and tokens that hold a placeholder word in them.

Positions are code points, ends exclusive. Defined cases. Null or empty text: no spans. Very long texts and candidates: one
pass. Repeated rows: one row each out. Empty table: empty result. Other columns aren't read by ``scan`` and stay in ``redacted``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # whole runs: 20 letters and more
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a letter that a window must pass, by class: hex digits, letters of one case and digits, letters and digits, all (slug: of one case). Of random windows 0.5 % lie below, slugs aside.
BOUNDS = {"hex": 2.83, "single": 3.33, "alnum": 3.57, "token": 3.57, "slug": 4.0}
ALLOWED = re.compile(
    r"(?:[A-Za-z]+[-_/+=])*[A-Za-z]+"  # words, also joined by signs
    r"|[0-9+/_=-]+"  # numbers and rules
)
#: Cut out of a run: UUIDs, and tokens with a placeholder word.
HARMLESS = re.compile(
    r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])[A-Za-z0-9]*?(?:EXAMPLE|example|placeholder|xxxxxx|XXXXXX)[A-Za-z0-9]*"
)
_PARTS = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]


def class_of(window: str) -> str | None:
    """The narrowest class of a window; None if it doesn't mix letters as keys do."""
    digits = sum(c.isdigit() for c in window)
    if not digits:
        return None
    if all(c in "0123456789abcdefABCDEF" for c in window):
        return "hex" if digits < len(window) else None
    signs, lower = sum(not c.isalnum() for c in window), any(c.islower() for c in window)
    if not (lower and any(c.isupper() for c in window)):
        if signs:
            return "slug" if digits >= 3 else None
        return "single" if digits >= 1 + lower and digits < len(window) else None
    return ("token" if signs <= 3 and window.count("-") + window.count("_") <= 2 else None) if signs else "alnum"  # dates and titles in paths have more signs


def entropy_spans(run: str) -> list[tuple[int, int]]:
    """Spans of ``run`` that are covered by windows over their class's bound."""
    spans: list[list[int]] = []
    counts: dict[str, int] = {}
    total = 0.0  # sum of n * log2(n)
    least = min(BOUNDS.values())
    for i, c in enumerate(run):
        n = counts[c] = counts.get(c, 0) + 1
        total += _PARTS[n] - _PARTS[n - 1]
        if i >= WINDOW:
            old = run[i - WINDOW]
            n = counts[old]
            total += _PARTS[n - 1] - _PARTS[n]
            counts[old] = n - 1
        if i >= WINDOW - 1:
            bits = math.log2(WINDOW) - total / WINDOW
            if bits > least:
                start = i - WINDOW + 1
                kind = class_of(run[start : i + 1])
                if kind is not None and bits > BOUNDS[kind]:
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([start, i + 1])
    return [(a, b) for a, b in spans]


def grown_spans(run: str) -> list[tuple[int, int]]:
    """Spans of the parts of ``run`` between what is harmless, each grown to the tokens it touches."""
    spans: list[list[int]] = []
    cuts = [(-1, 0), *(m.span() for m in HARMLESS.finditer(run)), (len(run), -1)]
    for (_, start), (end, _) in zip(cuts[:-1], cuts[1:], strict=True):
        part = run[start:end]
        if len(part) < WINDOW:
            continue
        for a, b in entropy_spans(part):
            while a > 0 and part[a - 1].isalnum():
                a -= 1
            while b < len(part) and part[b].isalnum():
                b += 1
            if spans and start + a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], start + b)
            else:
                spans.append([start + a, start + b])
    return [(a, b) for a, b in spans]


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start and then by kind as listed in KINDS."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b in found)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if ALLOWED.fullmatch(run):
            continue
        for a, b in grown_spans(run):
            a, b = a + m.start(), b + m.start()
            k = bisect_right(starts, a)
            if not k or reach[k - 1] < b:
                found.append(("entropy", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row; spans: array of (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], ["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", SPANS)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts and the spans as text, ``kind:start:end`` joined by commas."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """The text with every secret replaced by ``mark``; overlapping spans make one."""
    out, at = [], 0
    for _, a, b in scan_text(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text, and ``length_col`` set to its new number of code points where it changed."""
    names, at = docs.columns, docs.columns.index(text_col)
    length = names.index(length_col) if length_col in names else None
    docs = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [None if t is None else redact_text(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length is not None:
                sizes = batch.column(length).to_pylist()
                columns[length] = pa.array([n if a == b else len(b) for n, a, b in zip(sizes, old, new, strict=True)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema).toDF(*names)
