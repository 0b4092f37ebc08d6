import pytest

from sparkbrook.plans.config import ConfigError, EngineConfig, operator
from sparkbrook.plans.lifecycle import Registry, exit_code, load_request, shutdown_order
from sparkbrook.plans.placement import PlacementError, Thread, added, least_used, load_thread, removed, startup_thread

NEEDED = {"output_path": "out", "sandbox_run_path": "run", "io_lua_path": "io", "io_lua_cpath": "io", "analysis_lua_path": "a", "analysis_lua_cpath": "a"}
CONFIG = EngineConfig.from_dict(NEEDED)


def test_defaults():
    assert (CONFIG.max_message_size, CONFIG.output_size, CONFIG.backpressure, CONFIG.backpressure_disk_free, CONFIG.analysis_threads, CONFIG.analysis_utilization_limit) == (65536, 67108864, 0, 4, 1, 95)
    d = CONFIG.input_defaults
    assert (d.output_limit, d.memory_limit, d.instruction_limit, d.preserve_data, d.restricted_headers) == (65536, 8388608, 1_000_000, False, False)
    assert CONFIG.analysis_defaults.restricted_headers and not CONFIG.output_defaults.restricted_headers


def test_given_values():
    c = EngineConfig.from_dict(NEEDED | {"output_size": 1024, "backpressure": 10, "input_defaults": {"output_limit": 1023, "memory_limit": 32767, "instruction_limit": 1000, "preserve_data": True}, "output_defaults": {"remove_checkpoints_on_terminate": True, "read_queue": "both"}})
    assert (c.output_size, c.backpressure, c.input_defaults.output_limit, c.input_defaults.memory_limit, c.input_defaults.instruction_limit, c.input_defaults.preserve_data) == (1024, 10, 1023, 32767, 1000, True)


@pytest.mark.parametrize("bad", [{"extra": True}, {"input_defaults": {"output_limit": 66560}}, {"input_defaults": {"extra": 1}}, {"max_message_size": 1023}, {"analysis_threads": 0}, {"analysis_threads": 65}, {"analysis_utilization_limit": 101}, {"output_path": 3}, {"output_size": "1"}, {"input_defaults": {"preserve_data": 1}}])
def test_refused(bad):
    with pytest.raises(ConfigError):
        EngineConfig.from_dict(NEEDED | bad)


def test_operators(spark):
    i = operator(CONFIG, "input", "input.cfg", {"filename": "input.lua"})
    assert (i.name, i.message_matcher, i.async_buffer_size, i.thread) == ("input.input", None, 0, None)
    a = operator(CONFIG, "analysis", "a.cfg", {"filename": "a.lua", "message_matcher": "TRUE", "thread": 1, "ticker_interval": 17, "output_limit": 1000, "foo": {"bar": [1, 2]}})
    assert (a.thread, a.ticker_interval, a.read_config("foo"), a.read_config("ticker_interval"), a.timer_event_inject_limit) == (1, 17, {"bar": [1, 2]}, 17, 10)
    o = operator(CONFIG, "output", "o.cfg", {"filename": "o.lua", "message_matcher": "TRUE", "async_buffer_size": 999, "remove_checkpoints_on_terminate": True, "read_queue": "input"})
    assert (o.async_buffer_size, o.remove_checkpoints_on_terminate, o.read_queue) == (999, True, "input")


@pytest.mark.parametrize(("kind", "file", "given"), [
    ("input", "x.cfg", {"filename": "a/b.lua"}), ("input", "x.cfg", {"filename": "b.txt"}), ("input", "x.cfg", {"filename": ".lua"}), ("input", "x.off", {"filename": "b.lua"}), ("input", ".cfg", {"filename": "b.lua"}),
    ("analysis", "x.cfg", {"filename": "b.lua"}), ("output", "x.cfg", {"filename": "b.lua", "message_matcher": "bad ="}), ("output", "x.cfg", {"filename": "b.lua", "message_matcher": "TRUE", "read_queue": "x"}),
    ("input", "x.cfg", {"filename": "b.lua", "output_limit": 1 << 20}), ("input", "x.cfg", {"filename": "b.lua", "ticker_interval": -1}), ("input", "x.cfg", {"filename": "b.lua", "preserve_data": "yes"}),
])
def test_operators_refused(spark, kind, file, given):
    with pytest.raises(ConfigError):
        operator(CONFIG, kind, file, given)


def test_placement():
    threads = [Thread(2, 40), Thread(1, 40), Thread(0, 90)]
    assert least_used(threads, 95) == 1
    assert least_used([Thread(1, 95)], 95) is None and least_used([Thread(1, 95)], 0) == 0
    assert startup_thread(5, None, threads) == 2 and startup_thread(None, 1, threads) == 1 and startup_thread(None, None, threads) == 2
    with pytest.raises(PlacementError):
        load_thread(1, 0, threads, 95)
    with pytest.raises(PlacementError):
        load_thread(None, None, [Thread(1, 96)], 95)
    assert load_thread(None, 2, threads, 95) == 2 and added(Thread(1, 253, 9)) == Thread(2, 255, 0) and removed(Thread(1, 3)) == Thread(0, 0)


def test_lifecycle():
    assert [load_request(f).action for f in ("a.cfg", "a.off", "a.lua", "a.txt", ".cfg")] == ["load", "stop", "restart", "ignore", "ignore"]
    assert exit_code(["input", "output", "output"]) == 10 and len(shutdown_order("batch")) == 3 and len(shutdown_order("service")) == 1
    r = Registry(run={"x.lua": 1}, installed={"x.lua": 2, "y.lua": 3}, checkpoints={"input->output.a": "1:0", "input->output.b": "1:0"})
    assert (r.code("x.lua"), r.code("y.lua")) == (1, 3)
    r.load("output.a", 1)
    assert r.terminate("output.a", "boom", "2020-01-01T00:00:00") == "2020-01-01T00:00:00\tboom" and "input->output.a" in r.checkpoints
    r.load("output.a", 1)
    assert not r.errors and r.restart_users("x.lua", {"output.a": "x.lua"}) == ["output.a"]
    r.stop("output.a")
    assert list(r.checkpoints) == ["input->output.b"]
