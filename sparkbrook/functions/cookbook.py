"""Decoders of common logs that have a form of their own: web servers' errors, slow queries, audit records and packet filters. All are Columns; null where a line doesn't match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decoders import logfmt

#: The access-log formats of web servers, as their configuration names them.
COMMON = '$remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent'
COMBINED = f'{COMMON} "$http_referer" "$http_user_agent"'

NGINX_ERROR = r"^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[(\w+)\] (\d+)#(\d+): (?:\*(\d+) )?([\s\S]*)$"
APACHE_ERROR = r"^\[(\w{3} \w{3} \d\d \d\d:\d\d:\d\d(?:\.\d+)? \d{4})\] \[(?:(\w*):)?(\w+)\] (?:\[pid (\d+)(?::tid (\d+))?\] )?(?:\[client ([^\]]+)\] )?([\s\S]*)$"
AUDIT = r"^(?:node=(\S+) )?type=(\S+) msg=audit\((\d+)\.(\d{3}):(\d+)\): ?([\s\S]*)$"
SLOW_HOST = r"# User@Host: ([^\[\s]*)\[[^\]]*\] @ *(\S*) *\[([^\]]*)\]"
SLOW_TIMES = r"# Query_time: ([\d.]+) +Lock_time: ([\d.]+) +Rows_sent: (\d+) +Rows_examined: (\d+)"


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def nginx_error(text: Column) -> Column:
    """struct(timestamp_ns, level, pid, tid, connection, msg, client, server, request, host): what follows the message as ``name: value`` is taken out of it."""
    rest = F.regexp_extract(text, NGINX_ERROR, 6)
    tail = lambda name: _part(rest, rf', {name}: "?((?<=")[^"]*|[^,"]*)', 1)
    stamp = F.unix_micros(F.try_to_timestamp(F.regexp_extract(text, NGINX_ERROR, 1), F.lit("yyyy/MM/dd HH:mm:ss"))) * 1000
    return F.when(text.rlike(NGINX_ERROR), F.struct(
        stamp.alias("timestamp_ns"), _part(text, NGINX_ERROR, 2).alias("level"), _part(text, NGINX_ERROR, 3).cast("int").alias("pid"), _part(text, NGINX_ERROR, 4).cast("long").alias("tid"),
        _part(text, NGINX_ERROR, 5).cast("long").alias("connection"), F.regexp_extract(rest, r"^([\s\S]*?)(?:, (?:client|server|request|upstream|host|referrer): |$)", 1).alias("msg"),
        *[tail(n).alias(n) for n in ("client", "server", "request", "host")]))


def apache_error(text: Column) -> Column:
    """struct(module, level, pid, client, msg)."""
    return F.when(text.rlike(APACHE_ERROR), F.struct(
        _part(text, APACHE_ERROR, 2).alias("module"), _part(text, APACHE_ERROR, 3).alias("level"), _part(text, APACHE_ERROR, 4).cast("int").alias("pid"), _part(text, APACHE_ERROR, 6).alias("client"),
        F.regexp_extract(text, APACHE_ERROR, 7).alias("msg")))


def audit(text: Column) -> Column:
    """struct(node, type, timestamp_ns, serial, fields): fields as ``logfmt`` gives them."""
    ns = (_part(text, AUDIT, 3).cast("long") * 1000 + _part(text, AUDIT, 4).cast("long")) * 1_000_000
    return F.when(text.rlike(AUDIT), F.struct(
        _part(text, AUDIT, 1).alias("node"), _part(text, AUDIT, 2).alias("type"), ns.alias("timestamp_ns"), _part(text, AUDIT, 5).cast("long").alias("serial"), logfmt(F.regexp_extract(text, AUDIT, 6)).alias("fields")))


def slow_query(record: Column) -> Column:
    """struct(user, host, ip, query_time, lock_time, rows_sent, rows_examined, timestamp_ns, query) of a record of several lines (``text_files.multiline`` with ``^# User@Host:``)."""
    number = lambda k: _part(record, SLOW_TIMES, k)
    query = F.regexp_extract(record, r"(?:^|\n)SET timestamp=\d+;\n([\s\S]*?);?\s*$", 1)
    return F.when(record.rlike(SLOW_TIMES), F.struct(
        _part(record, SLOW_HOST, 1).alias("user"), _part(record, SLOW_HOST, 2).alias("host"), _part(record, SLOW_HOST, 3).alias("ip"), number(1).cast("double").alias("query_time"), number(2).cast("double").alias("lock_time"),
        number(3).cast("long").alias("rows_sent"), number(4).cast("long").alias("rows_examined"), (_part(record, r"SET timestamp=(\d+);", 1).cast("long") * 1_000_000_000).alias("timestamp_ns"), query.alias("query")))


def packet_filter(text: Column) -> Column:
    """struct(rule, interface, reason, action, direction, version, protocol, length, source, destination, source_port, destination_port) of a packet filter's comma-separated line."""
    cells = F.split(text, ",")
    cell = lambda k: F.nullif(F.get(cells, F.lit(k)), F.lit(""))
    four = cell(8) == "4"
    pick = lambda a, b: F.when(four, cell(a)).otherwise(cell(b))
    protocol = F.lower(pick(16, 12))
    ports = protocol.isin("tcp", "udp")
    return F.when((F.size(cells) >= 17) & cell(8).isin("4", "6"), F.struct(
        cell(0).cast("long").alias("rule"), cell(4).alias("interface"), cell(5).alias("reason"), cell(6).alias("action"), cell(7).alias("direction"), cell(8).cast("int").alias("version"), protocol.alias("protocol"),
        pick(17, 14).cast("long").alias("length"), pick(18, 15).alias("source"), pick(19, 16).alias("destination"),
        F.when(ports, pick(20, 17).cast("int")).alias("source_port"), F.when(ports, pick(21, 18).cast("int")).alias("destination_port")))
