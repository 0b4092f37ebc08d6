import random

import pytest
from pyspark.sql import functions as F

from sparkbrook.functions.scalars import general_number
from sparkbrook.operators import delivery, merge, plugins, queues, routing, ticks, timers
from sparkbrook.operators.running import running
from sparkbrook.plans.config import OperatorSpec

def test_timer_report(spark):
    def line(pos, ns, kind, name):
        return pos, f"{ns} [debug] input.test {kind}_TIMER:{name}"

    rows = [
        line(0, 1000, "START", "parse"), line(1, 1040, "END", "parse"),
        line(2, 2000, "START", "send"), line(3, 2005, "START", "send"), line(4, 2020, "END", "send"), line(5, 2070, "END", "send"),
        line(6, 3000, "START", "parse"), line(7, 3046, "END", "parse"), line(8, 4000, "END", "only ends"), line(9, 5000, "START", "only starts"),
        (99, "5 [info] input.test START_TIMER:no"),
    ]
    lines = timers.timer_lines(spark.createDataFrame(rows, "pos long, value string"))
    got = {tuple(r) for r in timers.report_tsv(timers.report(lines)).collect()}
    assert got == {("parse", 2, "40", "46", "43", "4.24264"), ("send", 1, "20", "20", "20", "0"), ("only starts", 0, None, None, None, None)}


def test_general_number_rounds_as_c(spark):
    numbers = [12345650000.0, 12345750000.0, 1.234565e-5, 1.234575, 0.0001234565, 999999.5, 1e-5, -0.0, 1e300, 123456.5, -1234565.0, 100.0, float("inf"), float("nan"), None]
    wanted = ["1.23456e+10", "1.23458e+10", "1.23456e-05", "1.23457", "0.000123457", "1e+06", "1e-05", "-0", "1e+300", "123456", "-1.23456e+06", "100", "inf", "nan", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i long, x double")
    assert [r.g for r in df.select("i", general_number(F.col("x")).alias("g")).orderBy("i").collect()] == wanted


@pytest.mark.parametrize("seed", range(2))
def test_timer_pairs_by_a_state_machine(spark, seed):
    r = random.Random(seed)
    rows = [(i * r.choice((1, 70_000)) + i, i * 10 + r.randrange(10), r.choice(("START_TIMER", "END_TIMER")), r.choice("ab")) for i in range(200)]
    rows = list({x[0]: x for x in rows}.values())
    open_at, expected = {}, set()
    for pos, ns, prefix, name in sorted(rows):
        if prefix == "START_TIMER":
            open_at.setdefault(name, ns)
        elif name in open_at:
            expected.add((name, pos, ns - open_at.pop(name)))
    got = timers.pairs(spark.createDataFrame(rows, "pos long, ns long, prefix string, name string")).collect()
    assert {tuple(x) for x in got} == expected


def test_large_nanoseconds_stay_whole(spark):
    df = spark.createDataFrame([(0, 1508867134513040113, "START_TIMER", "a"), (1, 1508867134513060127, "END_TIMER", "a")], "pos long, ns long, prefix string, name string")
    assert timers.pairs(df).first().delta == 20014


@pytest.mark.parametrize("seed", range(4))
def test_running_by_blocks(spark, seed):
    r = random.Random(seed)
    data = [(r.choice("ab"), i, r.randint(-5, 50)) for i in r.sample(range(200), 60)]
    df = spark.createDataFrame(data, "k string, pos long, v long")
    got = {(x.k, x.pos): (x.s, x.m, x.b) for x in running(running(running(df, F.col("v"), "s", by=["k"], block=7), F.col("v"), "m", by=["k"], fold="max", block=7), F.col("v"), "b", by=["k"], before=True, block=7).collect()}
    for k, pos, _ in data:
        upto = [v for a, p, v in data if a == k and p <= pos]
        assert got[k, pos] == (sum(upto), max(upto), sum(v for a, p, v in data if a == k and p < pos))


@pytest.mark.parametrize("seed", range(4))
def test_ticks_against_a_simulation(spark, seed):
    r = random.Random(seed)
    data = [(i, r.randint(1000, 1200) * 10**9) for i in range(80)]
    clk = due = window = 0
    expected = []
    for pos, ns in data:
        clk = max(clk, ns // 10**9)
        fires = clk >= due
        expected.append((pos, clk, fires, window))
        if fires:
            due, window = clk + 25, window + 1
    got = ticks.windowed(spark.createDataFrame(data, "pos long, timestamp_ns long"), 25).orderBy("pos").select("pos", "clk", "fires", "window_id")
    assert [tuple(x) for x in got.collect()] == expected


@pytest.mark.parametrize("seed", range(4))
def test_merge_against_two_readers(spark, seed):
    r = random.Random(seed)
    data = [(q, i, r.randint(0, 30)) for q in ("input", "analysis") for i in range(r.randint(0, 25))] + [("input", 99, 31)]
    todo = {q: sorted((i, t) for a, i, t in data if a == q) for q in ("input", "analysis")}
    expected = []
    while todo["input"] or todo["analysis"]:
        a, b = todo["input"], todo["analysis"]
        q = "input" if a and (not b or a[0][1] <= b[0][1]) else "analysis"
        expected.append((q, todo[q].pop(0)[0]))
    df = spark.createDataFrame(data, "queue string, pos long, timestamp_ns long")
    assert [(x.queue, x.pos) for x in merge.delivery_order(df, span=7).orderBy("seq").collect()] == expected
    assert [(x.queue, x.pos) for x in merge.merge_oldest_first(df).collect()] == expected


def test_roll_example(spark):
    df = spark.createDataFrame([("input", i, s) for i, s in enumerate((3, 3, 4, 10, 1, 1))], "queue string, pos long, size long")
    assert [(x.file_id, x.offset) for x in queues.rolled(df, 6, size=F.col("size")).orderBy("pos").collect()] == [(0, 0), (0, 3), (1, 0), (1, 4), (2, 0), (2, 1)]


def test_backpressure_rises_holds_and_releases(spark):
    steps = [("roll", 3, 1, 9), ("roll", 9, 1, 9), ("check", 9, 8, 9), ("check", 9, 9, 4), ("check", 9, 9, 5), ("roll", 10, 10, 4)]
    df = spark.createDataFrame([("q", i, *s) for i, s in enumerate(steps)], "queue string, step long, kind string, writer_id long, min_id long, free long")
    assert [x.throttled for x in queues.backpressure(df, lag=5).orderBy("step").collect()] == [False, True, True, True, False, True]


def commit_state_machine(rows):
    """(pos, code, acked) in order: the position after each, as one output would keep it."""
    cp, batching, ended, out = None, False, False, []
    for pos, code, acked in rows:
        if not ended:
            if code is not None and code > 0 or code == delivery.ASYNC and not acked:
                ended = True
            elif code == delivery.ASYNC:
                cp = pos
            else:
                batching = code == delivery.BATCH or batching and code != delivery.SENT
                if not batching and code != delivery.RETRY:
                    cp = pos
        out.append(cp)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_commit_rules(spark, seed):
    fixed = [[0, delivery.ASYNC, 0, 1, 0], [0, delivery.BATCH, None, delivery.FAIL, 0, delivery.FAIL, delivery.RETRY, 0], [0, 0, 7, 0], [None, delivery.SKIP, delivery.BATCH, 1]]
    r = random.Random(seed)
    codes = fixed[seed] + [r.choice((0, 0, None, -1, -2, -3, -4, -5)) for _ in range(60 if seed % 2 else 0)]
    rows = [(i, c, r.random() < 0.97 if seed % 2 else None) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "pos long, code int, acked boolean")
    got = [x.cp for x in delivery.committed(df, acked="acked").orderBy("pos").collect()]
    assert got == commit_state_machine(rows)
    if not seed:
        assert got == [0, 0, 0, 0, 0]


def test_a_far_timestamp_splits(spark):
    """One message far in the future makes one head of all that follows; places stay right and no block holds the stream."""
    r = random.Random(5)
    rows = [(r.choice(("input", "analysis")), i, 10**18 + i * 10**9 if i != 50 else 4 * 10**18) for i in range(3000)]
    df = spark.createDataFrame(rows, "queue string, pos long, timestamp_ns long")
    got = {(x.queue, x.pos): x.seq for x in merge.delivery_order(df).collect()}
    heads, expected = {}, []
    for q, pos, ns in rows:
        heads[q] = max(heads.get(q, 0), ns)
        expected.append((heads[q], q != "input", pos, q))
    assert got == {(q, pos): k for k, (_, _, pos, q) in enumerate(sorted(expected), 1)}


def test_acknowledgements_out_of_order(spark):
    df = spark.createDataFrame([("o", 1, True), ("o", 2, False), ("o", 3, True)], "plugin string, pos long, acked boolean")
    assert delivery.commit_latest(df, ["plugin"]).first().cp == 3 and delivery.commit_contiguous(df, ["plugin"]).first().cp == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "queue string, pos long, timestamp_ns long, type string")
    assert ticks.tick_counts(ticks.windowed(df, 60)).count() == 0
    assert merge.delivery_order(df).count() == 0
    assert queues.rolled(df, 5, size=F.lit(1)).count() == 0
    assert routing.fan_out(df, {"a": F.lit(True)}).count() == 0


def test_enrich_by_broadcast_or_shuffle(spark):
    m = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "pos long, ip string")
    t = spark.createDataFrame([("a", "Milton", "US"), ("a", "Milton", "US")], "addr string, city string, country string")
    for limit in (10, 0):
        got = routing.enrich(m, t, "ip", "addr", {"city": "city", "country": "country"}, broadcast_rows=limit)
        assert sorted((x.pos, x.ip_city, x.ip_country) for x in got.collect()) == [(1, "Milton", "US"), (2, None, None), (3, None, None)]


class Picky(plugins.Plugin):
    seen = 0

    def process_message(self, message):
        self.seen += 1
        if message["v"] == 9:
            return 1, "nine"
        if message["v"] == 5:
            return -1
        if message["v"] == 7:
            for k in range(3):
                self.inject_payload("txt", f"p{k}", self.read_config("label"))
        return 0

    def timer_event(self, clk, shutdown):
        self.inject_payload("txt", "shutdown" if shutdown else "tick", self.seen)


def test_plugin_calls_limits_and_ends(spark):
    data = [(k, i, (1000 + 10 * i) * 10**9, v) for k, vs in {"a": (1, 5, 7, 1), "b": (1, 9, 1), "c": (1, 1)}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "k string, pos long, timestamp_ns long, v int")
    spec = OperatorSpec(kind="analysis", name="analysis.p", filename="p.lua", message_matcher="TRUE", ticker_interval=20, process_message_inject_limit=2, user={"label": "x"})
    got = {k: [] for k in "abc"}
    for r in plugins.run_plugin(df, spec, Picky, F.lit(True), columns=["v"], key=["k"]).collect():
        got[r.k].append((r.kind, r.clk, r.payload_name, r.payload))
    assert got["a"] == [("emission", 1000, "tick", "1"), ("emission", 1020, "p0", "x"), ("emission", 1020, "p1", "x"), ("terminated", 1020, None, "inject_payload limit exceeded"), ("failures", 1020, None, "1")]
    assert got["b"] == [("emission", 1000, "tick", "1"), ("terminated", 1010, None, "nine")]
    assert got["c"] == [("emission", 1000, "tick", "1"), ("emission", 1010, "shutdown", "2")]
    assert plugins.run_plugin(df.limit(0), spec, Picky, F.lit(True), columns=["v"]).count() == 0


def test_a_plugin_reads_its_message_framed(spark):
    from sparkbrook.sources.codec import decode, frames

    class Frames(plugins.Plugin):
        def process_message(self, message):
            data = self.read_message("framed")
            (_, _, payload), = frames(data)
            assert payload == self.read_message("raw") and decode(payload)["type"] == self.read_message("type") == message["type"]
            self.inject_payload("bin", "size", len(data))
            return 0

    from sparkbrook.plans.config import EngineConfig, operator
    from test_config import NEEDED

    spec = operator(EngineConfig.from_dict(NEEDED), "analysis", "f.cfg", {"filename": "f.lua", "message_matcher": "TRUE", "process_message_inject_limit": 1})
    df = spark.createDataFrame([(1, 10**18, "a"), (2, 10**18, "bb")], "pos long, timestamp_ns long, type string")
    out = plugins.run_plugin(df, spec, Frames, F.lit(True), columns=["type"]).collect()
    assert [r.kind for r in out] == ["emission"] * 2 and int(out[1].payload) == int(out[0].payload) + 1
