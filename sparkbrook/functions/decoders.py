"""Log decoders: templates, printf formats, logfmt and web-server formats, compiled to regular expressions and so to Columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BOOL, DOUBLE, FIELD, STRING, field

SYSLOG_TIME = r"[A-Z][a-z]{2} [ 0-9]\d \d\d:\d\d:\d\d"
#: Parts of a syslog template: what they match, by name.
SYSLOG_PARTS = {
    "TIMESTAMP": SYSLOG_TIME, "HOSTNAME": r"[^ ]+", "syslogtag": r"[^ :\[]+(?:\[\d+\])?:?", "msg": r"[\s\S]*", "PRI": r"\d{1,3}",
    "syslogseverity": r"\d", "syslogfacility": r"\d{1,2}", "programname": r"[^ :\[]+", "procid": r"\d+",
}
#: printf conversions: what they match, and whether the value is a number.
PRINTF = {"s": (r"[\s\S]*?", False), "d": (r"-?\d+", True), "i": (r"-?\d+", True), "u": (r"\d+", True), "x": (r"[0-9a-fA-F]+", False), "f": (r"-?\d+(?:\.\d+)?", True), "g": (r"-?\d+(?:\.\d+)?(?:e[+-]?\d+)?", True), "c": (r"[\s\S]", False)}
#: Web-server variables that hold numbers; all others are strings.
NUMBERS = frozenset({"msec", "status", "body_bytes_sent", "bytes_sent", "request_time", "request_length", "connection", "connection_requests", "upstream_response_time"})
#: Formats and units of web-server variables.
REPRESENTATIONS = {"remote_addr": "ipv4", "body_bytes_sent": "B", "bytes_sent": "B", "request_length": "B"}
FIELDS = T.ArrayType(FIELD)


def extract(text: Column, pattern: str, group: int) -> Column:
    """A group, or null where the pattern doesn't match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def syslog(text: Column, year: int, template: str = "%TIMESTAMP% %HOSTNAME% %syslogtag%%msg:::sp-if-no-1st-sp%%msg%") -> Column:
    """struct(timestamp_ns, hostname, programname, pid, msg) of a line; all null where it doesn't match. Lines have no year, so it is given."""
    names, out, at = [], ["^"], 0
    for m in re.finditer(r"%([A-Za-z]+)(?::[^%]*)?%", template):
        out.append(re.escape(template[at : m.start()]))
        at = m.end()
        if "sp-if-no-1st-sp" in m[0]:
            out.append(" ?")
            continue
        names.append(m[1])
        out.append(f"({SYSLOG_PARTS[m[1]]})")
    pattern = "".join(out) + re.escape(template[at:]) + "$"
    part = lambda name: extract(text, pattern, names.index(name) + 1) if name in names else F.lit(None).cast("string")
    tag = part("syslogtag")
    stamp = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(part("TIMESTAMP"), r" +", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    return F.struct(
        (F.unix_micros(stamp) * 1000).alias("timestamp_ns"), part("HOSTNAME").alias("hostname"),
        F.coalesce(F.regexp_extract(tag, r"^([^ :\[]+)", 1), part("programname")).alias("programname"),
        F.nullif(F.regexp_extract(tag, r"\[(\d+)\]", 1), F.lit("")).try_cast("int").alias("pid"), part("msg").alias("msg"),
    )


def printf_regex(spec: str) -> tuple[str, list[bool]]:
    """The regex of a printf format and, for each conversion, whether it is a number."""
    out, kinds, at = ["^"], [], 0
    for m in re.finditer(r"%(?:%|[-+ #0]*\d*(?:\.\d+)?(?:hh|h|ll|l|z|j)?([sdiuxfgc]))", spec):
        out.append(re.escape(spec[at : m.start()]))
        at = m.end()
        if m[1] is None:
            out.append("%")
            continue
        pattern, number = PRINTF[m[1]]
        out.append(f"({pattern})")
        kinds.append(number)
    return "".join(out) + re.escape(spec[at:]) + "$", kinds


def printf(text: Column, spec: str, names: Sequence[str]) -> Column:
    """struct of the named conversions, numbers as doubles; null where the text doesn't match."""
    pattern, kinds = printf_regex(spec)
    if len(kinds) != len(names):
        raise ValueError(f"{len(kinds)} conversions but {len(names)} names")
    cells = [extract(text, pattern, i + 1) for i in range(len(names))]
    return F.when(text.rlike(pattern), F.struct(*[(c.try_cast("double") if k else c).alias(n) for c, k, n in zip(cells, kinds, names, strict=True)]))


def printf_library(text: Column, specs: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first of several formats that matches, as a map of strings, with the number of the format under ``_format``."""
    out = F.lit(None).cast("map<string,string>")
    for i in range(len(specs) - 1, -1, -1):
        pattern, _ = printf_regex(specs[i][0])
        pairs = [x for k, n in enumerate(specs[i][1]) for x in (F.lit(n), F.regexp_extract(text, pattern, k + 1))]
        out = F.when(text.rlike(pattern), F.create_map(F.lit("_format"), F.lit(str(i)), *pairs)).otherwise(out)
    return out


LOGFMT = r'([^\s=]+)(?:=("(?:[^"\\]|\\.)*"|[^\s]*))?'
LOGFMT_TYPE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("flag", T.BooleanType())]))


def logfmt(text: Column) -> Column:
    """Array of (name, value, flag): ``key=value``, ``key="quoted value"``, and bare keys, which are true flags without a value."""
    pairs = F.regexp_extract_all(text, F.lit(LOGFMT), F.lit(0))

    def one(p: Column) -> Column:
        raw = F.regexp_extract(p, r"^[^\s=]+=([\s\S]*)$", 1)
        quoted = raw.startswith('"') & raw.endswith('"') & (F.length(raw) > 1)
        value = F.when(quoted, F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), r"\\(.)", "$1")).otherwise(raw)
        bare = ~p.contains("=")
        return F.struct(F.regexp_extract(p, r"^([^\s=]+)", 1).alias("name"), F.when(~bare, value).alias("value"), bare.alias("flag"))

    return F.transform(pairs, one)


def access_format(log_format: str) -> tuple[str, list[str]]:
    """The regex of a web server's ``log_format`` and its variables in order. A variable ends at the letter that follows it in the format."""
    out, names, at = ["^"], [], 0
    for m in re.finditer(r"\$(?:\{(\w+)\}|(\w+))", log_format):
        out.append(re.escape(log_format[at : m.start()]))
        at = m.end()
        stop = log_format[at : at + 1]
        out.append(f"([^{re.escape(stop)}]*)" if stop and stop not in '"]' else (r"((?:[^\"\\]|\\.)*)" if stop == '"' else r"([^\]]*)" if stop else r"([\s\S]*)"))
        names.append(m[1] or m[2])
    return "".join(out) + re.escape(log_format[at:]) + "$", names


def access_parts(text: Column, log_format: str) -> Column:
    """Array of a format's variables from one match of the line; null where the line doesn't match or has a control letter that marks the cuts."""
    pattern, names = access_format(log_format)
    marked = F.regexp_replace(text, pattern, "\x01" + "\x01".join(f"${i + 1}" for i in range(len(names))))
    parts = F.split(marked, "\x01")
    return F.when(marked.startswith("\x01") & ~text.contains("\x01") & (F.size(parts) == len(names) + 1), parts)


def _access_struct(parts: Column, names: Sequence[str]) -> Column:
    cell = lambda i, n: F.get(parts, F.lit(i + 1)).try_cast("double") if n in NUMBERS else F.get(parts, F.lit(i + 1))
    return F.struct(*[cell(i, n).alias(n) for i, n in enumerate(names)])


def access_log(text: Column, log_format: str) -> Column:
    """struct of a format's variables (numbers as doubles, null where they aren't numbers); null where the line doesn't match."""
    parts = access_parts(text, log_format)
    return F.when(parts.isNotNull(), _access_struct(parts, access_format(log_format)[1]))


def decode_access(lines: DataFrame, column: str, log_format: str) -> DataFrame:
    """The lines that match, with the format's variables as columns. Each line is matched once: a generator keeps the optimizer from repeating the match for every column."""
    _, names = access_format(log_format)
    once = F.filter(F.array(access_parts(F.col(column), log_format)), lambda p: p.isNotNull())
    cut = lines.select("*", F.explode(once).alias("__parts"))
    return cut.select(*lines.columns, _access_struct(F.col("__parts"), names).alias("__d")).select(*lines.columns, "__d.*")


def local_time_ns(text: Column) -> Column:
    """Nanoseconds of a web server's local time, ``10/Feb/2014:08:46:41 -0800``."""
    return F.unix_micros(F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))) * 1000


def seconds_ns(msec: Column) -> Column:
    """Nanoseconds of a web server's ``$msec``, seconds with milliseconds: taken to whole milliseconds, as the log has them."""
    return F.round(msec * 1000).cast("long") * 1_000_000


def access_fields(text: Column, log_format: str, keep_time: bool = True) -> Column:
    """The variables as an array of fields, with units and formats; the local time, or ``$msec``, becomes the field ``time`` in nanoseconds, or is left to the header."""
    _, names = access_format(log_format)
    decoded = access_log(text, log_format)
    out = []
    for name in names:
        if name in ("time_local", "msec"):
            if keep_time:
                out.append(field("time", local_time_ns(decoded[name]) if name == "time_local" else seconds_ns(decoded[name]), DOUBLE))
        else:
            out.append(field(name, decoded[name], DOUBLE if name in NUMBERS else STRING, REPRESENTATIONS.get(name)))
    return F.when(decoded.isNotNull(), F.array(*out))


def logfmt_fields(text: Column) -> Column:
    """The pairs as an array of fields: strings, and flags as booleans."""
    value, flag = field("", F.lit(None).cast("string")), field("", F.lit(True), BOOL)
    return F.transform(logfmt(text), lambda p: F.when(p["flag"], flag.withField("name", p["name"])).otherwise(value.withField("name", p["name"]).withField("v_string", p["value"])))


def syslog_messages(lines: DataFrame, column: str, year: int, *, logger: str, sub_decoders: Mapping[str, Column] | None = None, keep_payload: bool = True, template: str | None = None) -> DataFrame:
    """Message columns from syslog lines; ``sub_decoders``: arrays of fields by program, over the column ``payload``. Lines that don't match have a null timestamp."""
    head = syslog(F.col(column), year, template) if template else syslog(F.col(column), year)
    rows = lines.withColumn("__s", head).withColumn("payload", F.col("__s")["msg"])
    program = field("programname", F.col("__s")["programname"])
    extra = dispatch(F.col("__s")["programname"], sub_decoders or {}, F.array().cast(FIELDS))
    return rows.select(
        *lines.columns, F.col("__s")["timestamp_ns"].alias("timestamp_ns"), F.lit(None).cast("string").alias("type"), F.lit(logger).alias("logger"), F.lit(7).alias("severity"),
        (F.col("payload") if keep_payload else F.lit(None).cast("string")).alias("payload"), F.col("__s")["pid"].alias("pid"), F.col("__s")["hostname"].alias("hostname"),
        F.concat(F.coalesce(extra, F.array().cast(FIELDS)), F.array(program)).alias("fields"))


def dispatch(program: Column, decoders: Mapping[str, Column], otherwise: Column | None = None) -> Column:
    """The decoder of a program's name: sub-decoders by name, all of one type."""
    out = otherwise if otherwise is not None else F.lit(None)
    for name, decoded in decoders.items():
        out = F.when(program == name, decoded).otherwise(out)
    return out


def transform_fields(df: DataFrame, transforms: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Columns replaced by functions of themselves, by name; names that aren't there are left alone."""
    return df.withColumns({name: f(F.col(name)) for name, f in transforms.items() if name in df.columns})


def records(text: Column, delimiter: str) -> Column:
    """Array of the records of a text whose first lines match a regex (multi-line records); what comes before the first is dropped."""
    parts = F.split(text, f"(?m)(?={delimiter})")
    return F.filter(parts, lambda p: p.rlike(f"^(?:{delimiter.lstrip('^')})"))
