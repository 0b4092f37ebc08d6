"""Message matchers: expressions over header and fields, compiled to Columns so that filters reach the scan.

Grammar (its own; only ``TRUE``, equality and Lua patterns are fixed by the stream's documentation)::

    expr := or;  or := and ('||' and)*;  and := unary ('&&' unary)*;  unary := '!'? '(' expr ')' | TRUE | FALSE | test
    test := name op value;  op: == != < <= > >= =~ !~;  value: string | number | NIL | TRUE | FALSE
    name := Type | Logger | Hostname | EnvVersion | Payload | Uuid | Severity | Pid | Timestamp | Fields[name]

``=~`` and ``!~`` take Lua patterns, or Java regexes between slashes.
A test on an absent value is false, but for ``== NIL``; a ``!`` before it turns that around.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lua_patterns import to_regex

HEADERS = {"Type": "type", "Logger": "logger", "Hostname": "hostname", "EnvVersion": "env_version", "Payload": "payload", "Uuid": "uuid", "Severity": "severity", "Pid": "pid", "Timestamp": "timestamp_ns"}
_TOKEN = re.compile(r"""\s*(?:(?P<op>&&|\|\||==|!=|<=|>=|=~|!~|<|>|!|\(|\))|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<regex>/(?:[^/\\]|\\.)+/)|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>Fields\[[^\]]+\]|\w+))""")


_OPPOSITE = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">", "=~": "!~", "!~": "=~"}


class MatcherError(ValueError):
    """The expression doesn't parse; an operator with it is refused."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise MatcherError(f"unexpected input at {at}: {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


#: An expression and its opposite. Neither contains NOT, so an absent value (null) counts as false in both and plain comparisons reach the scan.
Pair = tuple[Column, Column]


class _Parser:
    def __init__(self, text: str, fields: Callable[[str], Column]):
        self.todo, self.at, self.fields = tokens(text), 0, fields

    def peek(self) -> tuple[str, str]:
        return self.todo[self.at] if self.at < len(self.todo) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def either(self) -> Pair:
        yes, no = self.both()
        while self.take("||"):
            y, n = self.both()
            yes, no = yes | y, no & n
        return yes, no

    def both(self) -> Pair:
        yes, no = self.unary()
        while self.take("&&"):
            y, n = self.unary()
            yes, no = yes & y, no | n
        return yes, no

    def unary(self) -> Pair:
        if self.take("!"):
            yes, no = self.unary()
            return no, yes
        if self.take("("):
            inner = self.either()
            if not self.take(")"):
                raise MatcherError("a bracket is not closed")
            return inner
        if self.take("TRUE"):
            return F.lit(True), F.lit(False)
        if self.take("FALSE"):
            return F.lit(False), F.lit(True)
        return self.test()

    def name(self) -> Column:
        kind, value = self.peek()
        if kind != "name":
            raise MatcherError(f"a name is expected, not {value!r}")
        self.at += 1
        if value.startswith("Fields["):
            return self.fields(value[7:-1])
        if value not in HEADERS:
            raise MatcherError(f"unknown name {value}")
        return F.col(HEADERS[value])

    def test(self) -> Pair:
        left, op = self.name(), self.take(*_OPPOSITE)
        kind, value = self.peek()
        if op is None or kind == "end":
            raise MatcherError("a comparison is expected")
        self.at += 1
        if value == "NIL" and kind == "name":
            if op not in ("==", "!="):
                raise MatcherError("NIL compares by == and != only")
            absent, present = left.isNull(), left.isNotNull()
            return (absent, present) if op == "==" else (present, absent)
        if op in ("=~", "!~"):
            if kind not in ("string", "regex"):
                raise MatcherError("a pattern is expected")
            hit = left.cast("string").rlike(value[1:-1] if kind == "regex" else to_regex(_unquote(value)))
            compare = lambda o: hit if o == "=~" else ~hit
        else:
            if kind == "string":
                right: Column = F.lit(_unquote(value))
            elif kind == "number":
                right = F.lit(int(value) if re.fullmatch(r"-?\d+", value) else float(value))
            elif value in ("TRUE", "FALSE"):
                right = F.lit(value == "TRUE")
            else:
                raise MatcherError(f"a value is expected, not {value!r}")
            tests = {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
            compare = tests.__getitem__
        return compare(op), left.isNull() | compare(_OPPOSITE[op])


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1])


def compile_matcher(text: str, promoted: Mapping[str, str] | None = None, map_column: str = "f_str") -> Column:
    """The Column of an expression. ``promoted``: columns of fields by name; others are looked up in ``map_column``."""
    known = promoted or {}
    parser = _Parser(text, lambda name: F.col(known[name]) if name in known else F.col(map_column)[name])
    out = parser.either()[0]
    if parser.peek()[0] != "end":
        raise MatcherError(f"unexpected {parser.peek()[1]!r}")
    return out
