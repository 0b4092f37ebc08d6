"""User-code inputs, wall-clock timers, and a supervisor over a run folder."""

import json
import time

import pytest
from test_config import NEEDED

from sparkbrook.plans.config import EngineConfig, operator
from sparkbrook.plans.supervisor import Supervisor
from sparkbrook.streaming.delivery import stop
from sparkbrook.streaming.inputs import Input, InputFailure, _Reader, _Run, input_stream
from sparkbrook.streaming.ticks import wall_clock_stream

CONFIG = EngineConfig.from_dict(NEEDED)
SPEC = operator(CONFIG, "input", "lines.cfg", {"filename": "lines.lua", "batch": 3, "total": 10})


class Numbers(Input):
    """Injects the next few numbers; the checkpoint is the next one."""

    def process_message(self, checkpoint):
        start = int(checkpoint or 0)
        for k in range(start, min(start + self.read_config("batch"), self.read_config("total"))):
            self.inject_message({"payload": str(k), "timestamp_ns": k}, k + 1)
        return 0


def test_an_input_goes_on_from_its_checkpoint(spark, tmp_path):
    def run():
        q = input_stream(spark, SPEC, Numbers).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        return q

    def rows():
        return sorted(int(r.payload) for r in spark.read.schema("payload string, logger string").parquet(str(tmp_path / "out")).collect())

    q = run()
    for _ in range(60):
        if (tmp_path / "out").exists() and len(rows()) >= 3:
            break
        time.sleep(0.5)
    assert stop(q)
    q = run()
    for _ in range(60):
        if len(rows()) == 10:
            break
        time.sleep(0.5)
    assert stop(q) and rows() == list(range(10))
    assert spark.read.parquet(str(tmp_path / "out")).first().logger == "input.lines"


def test_checkpoints_of_inputs():
    reader = _Reader(Numbers, SPEC, None)
    rows, end = reader.read(reader.initialOffset())
    assert len(list(rows)) == 3 and end == {"cp": 3, "n": 0}
    assert [r[5] for r in reader.readBetweenOffsets({"cp": 3, "n": 0}, {"cp": 5, "n": 0})] == ["3", "4"]

    def made(act):
        class One(Input):
            def process_message(self, checkpoint):
                return act(self)

        return lambda *a: One(*a)

    def sync(self):
        self.inject_message(None, "place é")
        self.log("a", 1)
        return -1, "try later"  # logged; what was injected counts

    run = _Run(made(sync), SPEC, {"cp": None, "n": 0})
    assert run.rows == [] and run.checkpoint == "place é"
    _, end = _Reader(made(sync), SPEC, None).read({"cp": "old", "n": 4})
    assert end == {"cp": "place é", "n": 0}
    plain = _Reader(made(lambda self: self.inject_message({"type": "x"})), SPEC, None)
    assert plain.read({"cp": None, "n": 2})[1] == {"cp": None, "n": 3} and len(list(plain.readBetweenOffsets({"cp": None, "n": 2}, {"cp": None, "n": 3}))) == 1
    assert _Run(made(lambda self: self.inject_message(None, "x" * 8191)), SPEC, {}).checkpoint == "x" * 8191
    for act in (lambda self: self.inject_message(None, "x" * 8192), lambda self: self.inject_message(None), lambda self: self.inject_message({}, [1]), lambda self: 1, lambda self: (2, "disk")):
        with pytest.raises(InputFailure):
            _Run(made(act), SPEC, {})


def test_ticks_of_the_wall_clock_come_without_data(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    spark.range(5).selectExpr("id AS pos").write.parquet(str(tmp_path / "in" / "a"))
    s = spark.readStream.schema("pos long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = wall_clock_stream(s, 1, s.pos > 0, stagger=0).writeStream.format("memory").queryName("wall_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    for _ in range(80):
        if spark.table("wall_out").count() >= 3:
            break
        time.sleep(0.5)
    assert stop(q)
    got = spark.table("wall_out").orderBy("tick_clk").collect()
    assert len(got) >= 3 and got[0].n == 4 and {r.n for r in got[1:]} == {0} and {r.n_total for r in got} == {4}


def rate_code(fail=False):
    def start(spark, spec, checkpoint):
        if spec.user.get("broken"):
            raise RuntimeError("broken\ttwice")

        def work(batch, i):
            if fail:
                raise RuntimeError("no disk")

        return spark.readStream.format("rate").load().writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).queryName(spec.name).start()

    return start


def test_a_run_folder(spark, tmp_path):
    run, load = tmp_path / "run", tmp_path / "load"
    cfg = lambda file, **more: json.dumps({"filename": file, **more})
    (run / "output").mkdir(parents=True)
    (run / "output" / "a.cfg").write_text(cfg("ok.lua", message_matcher="TRUE"))
    (run / "output" / "bad.cfg").write_text(cfg("ok.lua", message_matcher="nonsense ="))
    (run / "output" / "old.err").write_text("1970\told")
    s = Supervisor(spark, CONFIG, run, load, tmp_path / "cp", installed={"ok.lua": rate_code(), "fails.lua": rate_code(True)})
    s.start()
    assert set(s.running) == {"output.a"} and not (run / "output" / "old.err").exists()
    assert "message_matcher" in (run / "output" / "bad.err").read_text() and json.loads((run / "output" / "a.rtc").read_text())["read_queue"] == "both"
    first = s.running["output.a"][1].id

    (load / "output" / "b.cfg").write_text(cfg("fails.lua", message_matcher="TRUE", remove_checkpoints_on_terminate=True))
    (load / "input" / "i.cfg").write_text(cfg("ok.lua"))
    (load / "output" / "note.txt").write_text("ignored")
    assert s.poll() and set(s.running) >= {"output.a", "input.i"}
    for _ in range(80):
        if "output.b" in s.failed:
            break
        time.sleep(0.25)
        s.poll()
    assert "no disk" in (run / "output" / "b.err").read_text() or "output.b" in s.failed
    assert not (tmp_path / "cp" / "output.b").exists() and "output.b" not in s.running

    assert '_G["output.a"] = ' in s.save().read_text() or s.running["output.a"][1].lastProgress is None
    assert not list((tmp_path / "cp").glob("*.tmp"))
    (load / "output" / "ok.lua").write_text("new code")
    s.poll()
    second = s.running["output.a"][1]
    assert second.id == first and second.isActive  # the same checkpoints, a new run
    (load / "output" / "a.off").write_text("")
    s.poll()
    assert "output.a" not in s.running and not second.isActive and not (tmp_path / "cp" / "output.a").exists() and (run / "output" / "a.off").exists()

    (load / "output" / "c.cfg").write_text(cfg("ok.lua", message_matcher="TRUE", broken=True, shutdown_on_terminate=True))
    assert s.poll() is False
    last = s.running["input.i"][1]
    assert s.serve(every=0.1) == 8 and not last.isActive and not s.running
