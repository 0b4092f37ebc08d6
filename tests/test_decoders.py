import pytest
from pyspark.sql import functions as F

from sparkbrook.functions import decoders

#: Sample lines and the format they are decoded by; their decoded fields below must match.
LINE = "Feb 13 14:25:19 ubuntu sshd[7192]: Accepted publickey for foobar from 216.160.83.56 port 4242 ssh2"
NGINX = '127.0.0.1 - - [10/Feb/2014:08:46:41 -0800] "GET / HTTP/1.1" 304 0 "-" "Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:26.0) Gecko/20100101 Firefox/26.0"'
FORMAT = '$remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent "$http_referer" "$http_user_agent"'


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "value string").select(column.alias("d")).first().d


def plain(fields):
    return {f.name: (f.value_type, f.representation, next((v for v in (f.v_string, f.v_double, f.v_bool) if v is not None), None)) for f in fields}


def test_syslog(spark):
    d = one(spark, LINE, decoders.syslog(F.col("value"), 2018))
    assert (d.timestamp_ns, d.hostname, d.programname, d.pid) == (1518531919 * 10**9, "ubuntu", "sshd", 7192)
    assert d.msg == "Accepted publickey for foobar from 216.160.83.56 port 4242 ssh2"
    assert one(spark, "no syslog", decoders.syslog(F.col("value"), 2018)).timestamp_ns is None


def test_printf(spark):
    d = one(spark, "/tmp/input.tsv:23: invalid line", decoders.printf(F.col("value"), "%s:%lu: invalid line", ["path", "linenum"]))
    assert (d.path, d.linenum) == ("/tmp/input.tsv", 23.0)
    assert one(spark, "x", decoders.printf(F.col("value"), "%s:%lu: invalid line", ["path", "linenum"])) is None


def test_printf_library(spark):
    specs = [("%s line", ["a"]), ("%s %s for %s from %s port %d ssh2%s", ["authmsg", "method", "user", "ssh_remote_ipaddr", "ssh_remote_port", "extra"])]
    d = one(spark, LINE.split(": ", 1)[1], decoders.printf_library(F.col("value"), specs))
    assert d == {"_format": "1", "authmsg": "Accepted", "method": "publickey", "user": "foobar", "ssh_remote_ipaddr": "216.160.83.56", "ssh_remote_port": "4242", "extra": ""}


def test_logfmt(spark):
    d = one(spark, 'foo=bar a=14 baz="hello kitty" cool%story=bro f %^asdf ip=216.160.83.56', decoders.logfmt_fields(F.col("value")))
    assert plain(d) == {"foo": (0, None, "bar"), "a": (0, None, "14"), "baz": (0, None, "hello kitty"), "cool%story": (0, None, "bro"), "f": (4, None, True), "%^asdf": (4, None, True), "ip": (0, None, "216.160.83.56")}


def test_access_log_in_syslog(spark):
    df = spark.createDataFrame([(f"Jan 23 08:50:02 ubuntu nginx[1234]: {NGINX}",)], "value string")
    m = decoders.syslog_messages(df, "value", 2018, logger="input.function", sub_decoders={"nginx": decoders.access_fields(F.col("payload"), FORMAT)}).first()
    assert (m.timestamp_ns, m.logger, m.severity, m.payload, m.pid, m.hostname) == (1516697402 * 10**9, "input.function", 7, NGINX, 1234, "ubuntu")
    assert plain(m.fields) == {
        "remote_user": (0, None, "-"), "http_user_agent": (0, None, NGINX.split('"')[5]), "body_bytes_sent": (3, "B", 0.0), "remote_addr": (0, "ipv4", "127.0.0.1"),
        "time": (3, None, 1.392050801e18), "request": (0, None, "GET / HTTP/1.1"), "programname": (0, None, "nginx"), "http_referer": (0, None, "-"), "status": (3, None, 304.0)}


def test_records_of_several_lines(spark):
    d = one(spark, "head\n# User@Host: a\nx\n# User@Host: b\ny\n", decoders.records(F.col("value"), "^# User@Host:"))
    assert d == ["# User@Host: a\nx\n", "# User@Host: b\ny\n"]


def test_names_must_fit():
    with pytest.raises(ValueError, match="names"):
        decoders.printf("x", "%s", ["a", "b"])


def test_common_logs(spark):
    from sparkbrook.functions import cookbook

    d = one(spark, "[Wed Oct 11 14:32:52.123456 2023] [core:error] [pid 35] [client 10.0.0.1:99] File missing", cookbook.apache_error(F.col("value")))
    assert (d.module, d.level, d.pid, d.client, d.msg) == ("core", "error", 35, "10.0.0.1:99", "File missing")
    for bad in ("", "no such line"):
        for f in (cookbook.apache_error, cookbook.nginx_error, cookbook.audit, cookbook.slow_query, cookbook.packet_filter):
            assert one(spark, bad, f(F.col("value"))) is None
    d = one(spark, '9.9.9.9 - bob [10/Feb/2014:08:46:41 -0800] "GET / HTTP/1.1" 200 17 "-" "x y"', decoders.access_log(F.col("value"), cookbook.COMBINED))
    assert (d.remote_user, d.status, d.http_user_agent) == ("bob", 200.0, "x y")


def test_msec_becomes_time(spark):
    fields = one(spark, "1.5 ok", decoders.access_fields(F.col("value"), "$msec $request"))
    assert [(f.name, f.v_double) for f in fields if f.name == "time"] == [("time", 1.5e9)]
