import random

import pytest
from pyspark.sql import functions as F

from sparkbrook.functions.matcher import compile_matcher
from sparkbrook.operators import delivery, ticks
from sparkbrook.operators.delivery import FAIL, RETRY, SENT
from sparkbrook.plans.config import EngineConfig, operator
from sparkbrook.plans.engine import Engine, counter
from sparkbrook.schema import events
from sparkbrook.sources import sinks
from sparkbrook.sources.codec import decode, encode, frame, frames
from sparkbrook.sources.queue_files import FramedSource, FramedStream, QueueWriter, next_id, queue_ids, read_queue
from sparkbrook.sources.tcp import FramedServer, send
from sparkbrook.sources.text_files import lines_with_offsets, multiline, timer_log
from sparkbrook.streaming.delivery import Acknowledgements, Fatal, sink, stop, triggered
from sparkbrook.streaming.ticks import event_windows, tick_stream
from test_config import NEEDED

SF = "/root/testdata/sf0.001"
FIELDS = [{"name": "a", "value_type": 0, "representation": "x", "v_string": "é", "v_bytes": None, "v_int": None, "v_double": None, "v_bool": None},
          {"name": "b", "value_type": 3, "representation": None, "v_string": None, "v_bytes": None, "v_int": None, "v_double": -1.5, "v_bool": None},
          {"name": "c", "value_type": 4, "representation": None, "v_string": None, "v_bytes": None, "v_int": None, "v_double": None, "v_bool": False}]


def message(i):
    return {"uuid": f"{i:032x}", "timestamp_ns": 10**18 + i, "type": "t", "logger": "l", "severity": 3, "payload": "p" * (i % 300), "env_version": None, "pid": -1, "hostname": "h", "fields": FIELDS}


def test_codec_round_trip():
    assert decode(encode(message(5))) == message(5)
    assert decode(b"")["severity"] == 7
    with pytest.raises(ValueError, match="."):
        decode(b"\x0a\xff\x01")


def test_columns_are_framed_as_messages_are(spark):
    rows = [(i, f"t{i % 3}", None if i == 4 else "x" * (i * 40), i / 2) for i in range(60)]
    df = spark.createDataFrame(rows, "timestamp_ns long, type string, path string, status double")
    got = [decode(next(frames(bytes(r.frame)))[2]) for r in sinks.framed_columns(df, {"path": (0, None), "status": (3, "B")}).collect()]
    for m, (ns, kind, path, status) in zip(got, rows, strict=True):
        assert (m["timestamp_ns"], m["type"]) == (ns, kind)
        assert [(f["name"], f["representation"], f["v_string"], f["v_double"]) for f in m["fields"]] == [("path", None, path, None)] * (path is not None) + [("status", "B", None, status)]


def test_frames_with_damage():
    r = random.Random(3)
    payloads = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 127, 128, 300, 16384)]
    data = b"".join(map(frame, payloads))
    assert [p for _, _, p in frames(data)] == payloads
    assert [len(frame(b"x" * n)) - n for n in (0, 127, 128, 16383, 16384)] == [5, 5, 6, 6, 7]
    damaged = b"junk" + frame(b"one") + b"\x1e\x02\x08" + frame(b"two") + frame(b"three")[:-1]
    assert [(s, p) for _, s, p in frames(damaged)] == [(4, b"one"), (3, b"two")]


def fill(folder, n, limit=2000):
    w = QueueWriter(str(folder), limit)
    at = [w.append(encode(message(i))) for i in range(n)]
    w.close()
    return at


def test_queue_batch_scan_and_resume(spark, tmp_path):
    at = fill(tmp_path, 40)
    got = sorted((r.file_id, r.offset, r.timestamp_ns) for r in read_queue(spark, f"file://{tmp_path}").collect())
    assert got == [(a, b, 10**18 + i) for i, (a, b) in enumerate(at)] and at[-1][0] > 1
    assert read_queue(spark, f"file://{tmp_path}", after=at[25]).count() == 15
    more = fill(tmp_path, 1)
    assert more[0][0] == queue_ids(str(tmp_path))[-1] or more[0][0] >= at[-1][0]
    assert next_id([1, 4, 9], 4) == 9 and next_id([1], 1) is None
    first = read_queue(spark, f"file://{tmp_path}").orderBy("file_id", "offset").first()
    assert first.fields[1].v_double == -1.5 and first.fields[2].v_bool is False and first.error is None


def test_framed_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(FramedSource)
    folder, out, cp = tmp_path / "q", str(tmp_path / "out"), str(tmp_path / "cp")
    fill(folder, 20)

    def run():
        s = spark.readStream.format("framed").option("path", str(folder)).load().select("file_id", "offset", "timestamp_ns")
        triggered(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp), 0, run_once=True).start().awaitTermination(120)
        return sorted(r.timestamp_ns for r in spark.read.parquet(out).collect())

    assert run() == [10**18 + i for i in range(20)]
    fill(folder, 7)
    assert run() == sorted([10**18 + i for i in range(20)] + [10**18 + i for i in range(7)])
    assert spark.read.format("framed").option("path", str(folder)).load().count() == 27


def test_tcp_lands_in_the_queue(spark, tmp_path):
    w = QueueWriter(str(tmp_path))
    server = FramedServer(w, port=0)
    assert send([encode(message(i)) for i in range(50)], port=server.port) == 50
    for _ in range(100):
        if read_queue(spark, f"file://{tmp_path}").count() == 50:
            break
    server.close()
    assert read_queue(spark, f"file://{tmp_path}").count() == 50
    assert send([b"x"], port=1, wait=0, tries=2) == 0


def test_tick_stream_equals_the_batch_operator(spark, tmp_path):
    e = events(spark, SF).withColumn("timestamp_ns", F.col("timestamp_ns") - F.col("pos") % 7 * F.lit(3_600_000_000_000)).select("pos", "timestamp_ns", "type")
    for k in range(3):
        e.where(f"pos >= {k * 400} and pos < {k * 400 + 400}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    hit = compile_matcher("Type == 'error'")
    q = tick_stream(s, 3600, hit).writeStream.format("memory").queryName("ticks_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = {tuple(r) for r in spark.table("ticks_out").drop("plugin").collect()}
    batch = ticks.tick_counts(ticks.windowed(e, 3600), hit).where("not is_shutdown").select("window_id", "tick_clk", "n_messages", "n", "n_total")
    assert got == {tuple(r) for r in batch.collect()}


def test_output_codes(spark, tmp_path):
    df = spark.range(5)
    calls = []

    def output(batch, batch_id):
        calls.append(batch_id)
        return RETRY if len(calls) < 3 else FAIL

    sink(output, str(tmp_path / "dead"), wait=0)(df, 7)
    assert calls == [7, 7, 7] and spark.read.parquet(str(tmp_path / "dead")).count() == 5
    sink(lambda b, i: SENT)(df, 8)
    with pytest.raises(RuntimeError, match="code 1"):
        sink(lambda b, i: 1)(df, 9)


def test_watermarked_windows_and_stopping(spark, tmp_path):
    e = events(spark, SF).select("pos", "timestamp_ns", "type")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = event_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), 60)
    q = s.writeStream.outputMode("update").format("memory").queryName("windows_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    assert stop(q) and sum(r.n for r in spark.table("windows_out").collect()) == 1000


def test_lines_have_byte_offsets(spark, tmp_path):
    text = "é1\nbb\n\nccc\n"
    (tmp_path / "a.log").write_text(text)
    got = [(r.pos, r.offset, r.value) for r in lines_with_offsets(spark, str(tmp_path / "a.log")).orderBy("pos").collect()]
    assert got == [(0, 0, "é1"), (1, 4, "bb"), (3, 8, "ccc")]
    (tmp_path / "t.log").write_text("0 [debug] input.test START_TIMER:foo\nx\n9 [debug] input.test END_TIMER:foo\n")
    assert timer_log(spark, str(tmp_path / "t.log")).count() == 2
    (tmp_path / "m.log").write_text("# T: 1\na\n# T: 2\nb\n")
    assert multiline(spark, str(tmp_path / "m.log"), "^# T:").count() == 2
    (tmp_path / "n.log").write_text("head\n# T: 1\na\n\nb\n# T: 2\nc")
    assert sorted((r.offset, r.record) for r in multiline(spark, str(tmp_path / "n.log"), "^# T:").collect()) == [(5, "# T: 1\na\n\nb"), (17, "# T: 2\nc")]
    (tmp_path / "b.log").write_text("a|b||c|")
    assert [(r.pos, r.offset, r.value) for r in lines_with_offsets(spark, str(tmp_path / "b.log"), delimiter="|").orderBy("pos").collect()] == [(0, 0, "a"), (1, 2, "b"), (3, 5, "c")]


def test_a_large_file_is_many_tasks_with_right_offsets(spark, tmp_path):
    lines = [f"line {k} " + "é" * (k % 50) for k in range(20_000)]
    (tmp_path / "l.log").write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = lines_with_offsets(spark, str(tmp_path / "l.log")).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    at = 0
    for k, (line, r) in enumerate(zip(lines, got, strict=True)):
        assert (r.pos, r.offset, r.value) == (k, at, line)
        at += len(line.encode()) + 1


def test_a_sink_loses_nothing(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(Fatal):
        sink(lambda b, i: delivery.RETRY, wait=0.0, tries=2)(df, 0)
    sink(lambda b, i: delivery.RETRY, str(tmp_path / "dead"), wait=0.0, tries=2)(df, 0)
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 3
    with pytest.raises(Fatal):
        sink(lambda b, i: delivery.BATCH)(df, 0)
    acks, asked = Acknowledgements(), []

    def settled(i):
        asked.append(i)
        if len(asked) == 3:
            acks.acknowledge(i)
        return acks.settled(i)

    sink(lambda b, i: delivery.ASYNC, settled=settled, wait=0.0)(df, 7)
    assert asked == [7, 7, 7] and acks.settled(6) and not acks.settled(8)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 50, 10, 90, 0)], "p string, m long, u long, mm long, pm long, te long")
    sinks.write_utilization(df, str(tmp_path / "u"))
    assert next((tmp_path / "u").glob("*.csv")).read_text().splitlines() == ["Plugin\tMessages Processed\t% Utilization\t% Message Matcher\t% Process Message\t% Timer Event", "a\t1\t50\t10\t90\t0"]
    cps = spark.createDataFrame([("input->a", '1:2"\n', None), ("input.n", None, 0.1), ("input.m", None, 14.0)], "key string, value string, number double")
    sinks.write_checkpoints(cps, str(tmp_path / "c"))
    assert sorted(next((tmp_path / "c").glob("*.txt")).read_text().splitlines()) == ['_G["input->a"] = "1:2\\"\\n"', '_G["input.m"] = 14', '_G["input.n"] = 0.10000000000000001']
    err = spark.createDataFrame([("p", 0, "boom")], "plugin string, at_us long, error string")
    assert sinks.termination_records(err).first().value == "1970-01-01T00:00:00\tboom"
    m = read_back = spark.createDataFrame([tuple(message(i)[k] for k in ("uuid", "timestamp_ns", "type")) for i in range(9)], "uuid string, timestamp_ns long, type string")
    sinks.append_queue(m, str(tmp_path / "q"))
    assert read_queue(spark, f"file://{tmp_path}/q").count() == 9
    sinks.write_framed(read_back, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 9


def test_engine(spark):
    config = EngineConfig.from_dict(NEEDED)
    a = operator(config, "analysis", "errors.cfg", {"filename": "c.lua", "message_matcher": "Type == 'error'", "ticker_interval": 3600})
    o = operator(config, "output", "all.cfg", {"filename": "o.lua", "message_matcher": "Severity <= 3", "read_queue": "analysis"})
    e = Engine({a.name: (a, counter)}, {o.name: o}, {"value": "value"})
    emitted = e.analyse(events(spark, SF))
    assert set(emitted.columns) == {"window_id", "payload_name", "payload", "plugin"} and emitted.count() > 50
    assert e.deliver(events(spark, SF))[o.name].count() == events(spark, SF).where("type = 'error'").count()


def test_queue_reader_goes_on_and_takes_files_in_turn(tmp_path):
    w = QueueWriter(str(tmp_path), limit=200)
    for i in range(30):
        w.append(encode(message(i)))
    w.flush()
    ids = queue_ids(str(tmp_path))
    assert len(ids) > 5
    stream, at, seen = FramedStream({"path": str(tmp_path), "max_files": "2"}), None, 0
    at = stream.initialOffset()
    while True:
        end = stream.latestOffset()
        if end == at:
            break
        assert sum(i > at["id"] for i in ids if i <= end["id"]) <= 2 + (at["offset"] == 0)
        seen += sum(len(list(stream.read(p))) for p in stream.partitions(at, end))
        at = end
    w.append(encode(message(99)))
    w.flush()
    end = stream.latestOffset()
    seen += sum(len(list(stream.read(p))) for p in stream.partitions(at, end))
    w.close()
    assert seen == 31


def test_a_queue_is_appended_by_all_tasks(spark, tmp_path):
    q = str(tmp_path / "q")
    rows = [tuple(message(i)[k] for k in ("uuid", "timestamp_ns", "type", "payload")) for i in range(200)]
    df = spark.createDataFrame(rows, "uuid string, timestamp_ns long, type string, payload string")
    sinks.append_queue(df.repartitionByRange(4, "timestamp_ns").sortWithinPartitions("timestamp_ns"), q, limit=4_000)
    ids = queue_ids(q)
    assert len(ids) > 4 and ids == list(range(len(ids)))
    got = [r.timestamp_ns for r in read_queue(spark, f"file://{q}").orderBy("file_id", "offset").collect()]
    assert got == [10**18 + i for i in range(200)]  # files are in order of the partitions
    sinks.append_queue(df.limit(3).coalesce(1), q)
    assert queue_ids(q)[-1] == len(ids) and read_queue(spark, f"file://{q}").count() == 203

    spark.range(50).selectExpr("id AS timestamp_ns", "'t' AS type").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("timestamp_ns long, type string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "streamed")
    for _ in range(2):  # the second run finds nothing new
        w = s.writeStream.format("framed").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        w.awaitTermination(60)
    assert read_queue(spark, f"file://{out}").count() == 50
