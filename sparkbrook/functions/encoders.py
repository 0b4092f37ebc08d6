"""Encoders of rows as text: tab-separated, HTML and plain lines. All are Columns over columns that are read as text; nulls are empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def tsv(columns: Sequence[str]) -> Column:
    """A line of tab-separated values; tabs, line ends and backslashes within a value are escaped."""
    return F.concat_ws("\t", *[_replaced(_text(c), (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))) for c in columns])


def html_row(columns: Sequence[str]) -> Column:
    """A row of an HTML table; what would be markup is escaped."""
    cells = [F.concat(F.lit("<td>"), _replaced(_text(c), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))), F.lit("</td>")) for c in columns]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def txt(columns: Sequence[str]) -> Column:
    """``name: value`` pairs on one line."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{c}: "), _text(c)) for c in columns])
