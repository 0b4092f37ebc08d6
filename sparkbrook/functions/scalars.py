"""Scalar functions of the stream engine, all as Columns."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("panic", "alert", "crit", "error", "warning", "notice", "info", "debug")


def round_percentage(n: Column, d: Column) -> Column:
    """Whole per cent of n / d: thousandths cut off, the last digit rounded up above five, and at five where the per cent is odd. 0 for d = 0."""
    tenths = F.when(d == 0, F.lit(0).cast("long")).otherwise(_div(n * 1000, F.nullif(d, F.lit(0))))
    percent, last = _div(tenths, F.lit(10)), F.abs(tenths) % 10
    return percent + F.when((last > 5) | ((last == 5) & (F.abs(percent) % 2 == 1)), 1).otherwise(0)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def max_rate(total_ns: Column, per_call: Column, before: Column) -> Column:
    """Estimated most messages a second: from nanoseconds spent and messages handled, at least what was seen before and now."""
    each = _div(total_ns, F.nullif(per_call, F.lit(0)))
    estimate = F.when(F.coalesce(each, F.lit(0)) == 0, 1).otherwise(_div(F.lit(1_000_000_000), F.nullif(each, F.lit(0))) + 1)
    return F.greatest(before.cast("long"), estimate, per_call.cast("long"))


def varint_length(n: Column) -> Column:
    """Bytes of a number of at least 0, seven bits a byte."""
    out = F.lit(9)
    for size in range(8, 0, -1):
        out = F.when(n < F.lit(1 << 7 * size), size).otherwise(out)
    return out


def frame_length(n: Column) -> Column:
    """Bytes on the wire of a message of n bytes: separators, header and unit mark, and the length itself."""
    return n + varint_length(n) + 4


def seconds(ns: Column) -> Column:
    return _div(ns, F.lit(1_000_000_000))


def file_id(name: Column) -> Column:
    """The number in ``<digits>.log``; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)\.log$", 1), F.lit("")).cast("long")


def has_extension(name: Column, extension: str) -> Column:
    """Whether a name ends in it and has something before."""
    return name.endswith(extension) & (F.length(name) > len(extension))


def plugin_name(kind: Column, config: Column) -> Column:
    """``type.basename`` of a configuration file."""
    return F.concat(kind, F.lit("."), F.regexp_replace(config, r"\.[^.]*$", ""))


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def escape_string(s: Column) -> Column:
    """With backslashes before line ends, quotes and backslashes, as a quoted string needs."""
    for plain, safe in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        s = F.replace(s, F.lit(plain), F.lit(safe))
    return s


def format_position(id_: Column, offset: Column) -> Column:
    return F.concat_ws(":", id_.cast("string"), offset.cast("string"))


def parse_position(s: Column) -> Column:
    """struct(id, offset) of ``id:offset``; nulls where it isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(s, r"^(\d+):(\d+)$", k), F.lit("")).cast("long")
    return F.struct(part(1).alias("id"), part(2).alias("offset"))


def parse_checkpoint_key(key: Column) -> Column:
    """struct(queue, kind, name): of ``queue``, ``queue->reader``, ``input.plugin`` (queue null); kind is the part before the point, or ``analysis`` with a thread number."""
    text = lambda pattern, k: F.nullif(F.regexp_extract(key, pattern, k), F.lit(""))
    reader = F.coalesce(text(r"^[^>]*->(.+)$", 1), F.when(key.contains("."), key))
    thread = F.nullif(F.regexp_extract(reader, r"^analysis(\d+)$", 1), F.lit(""))
    return F.struct(
        F.coalesce(text(r"^([^>]*)->", 1), F.when(~key.contains("."), key)).alias("queue"),
        F.when(thread.isNotNull(), "analysis").otherwise(F.nullif(F.regexp_extract(reader, r"^([^.]+)\.", 1), F.lit(""))).alias("kind"),
        F.coalesce(thread, F.nullif(F.regexp_extract(reader, r"^[^.]+\.(.+)$", 1), F.lit(""))).alias("name"),
    )


def severity_name(level: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), level.cast("int")), F.lit("debug"))


def utc_second(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss")


def free_units(free_bytes: Column, unit: Column) -> Column:
    """Free disk space in queue files; 0 without a unit or a figure."""
    return F.coalesce(_div(free_bytes, F.nullif(unit, F.lit(0))), F.lit(0))


def general_number(x: Column) -> Column:
    """A number as C's %g prints it: six digits, no zeros at the end, exponent of two digits outside 1e-5 to 1e6.

    C rounds the binary value, a true tie to the even digit. Spark's own functions round the shortest decimal form, ties up, so it is made in Python."""

    def digits(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else "%g" % v for v in values.to_pylist()], pa.string())

    return F.arrow_udf(digits, T.StringType())(x.cast("double"))


def log_line(ns: Column, level: Column, name: Column, text: Column) -> Column:
    """A line of the daemon's log."""
    return F.concat(ns.cast("string"), F.lit(" ["), severity_name(level), F.lit("] "), name, F.lit(" "), text)


def exact_number(x: Column) -> Column:
    """A number as C's %.17g prints it: the digits that give the same number again. Spark's own functions print the shortest such form, so these few are made in Python."""

    def digits(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else "%.17g" % v for v in values], dtype=object)

    return F.pandas_udf(digits, T.StringType())(x.cast("double"))
