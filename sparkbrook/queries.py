"""Queries over the message stream, and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import decoders, scalars
from .functions.matcher import compile_matcher
from .operators import checkpoints, delivery, merge, plugins, queues, routing, telemetry, ticks, timers
from .operators.running import running
from .plans.config import OperatorSpec
from .schema import DOUBLE, EVENTS_SQL, events, field, micros, numbers, read, strings

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
HOUR = 3600
M = f"m AS ({EVENTS_SQL})"
PROMOTED = {"user_id": "user_id", "value": "value"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from . import feature_queries  # noqa: F401 - registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import feature_queries  # noqa: F401

    return dict(_SQL)


def _take(expression: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.match(events(spark, sf_dir), expression, PROMOTED).select("pos", "type", "timestamp_ns")


def _taken(where: str) -> str:
    return f"WITH {M} SELECT pos, type, timestamp_ns FROM m WHERE {where}"


# Matchers


@query(_taken("true"))
def match_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _take("TRUE", spark, sf_dir)


@query(_taken("type = 'error'"))
def match_type_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _take("Type == 'error'", spark, sf_dir)


@query(_taken("(type = 'error' OR type = 'signup') AND severity <= 3 AND NOT (value > 100.5)"))
def match_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _take("(Type == 'error' || Type == \"signup\") && Severity <= 3 && !(Fields[value] > 100.5)", spark, sf_dir)


@query(_taken(r"regexp_matches(payload, '^\{\"k\": [0-9]+\}$') AND regexp_matches(hostname, 'host[13579]') AND NOT regexp_matches(type, '^[a-c]')"))
def match_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _take("Payload =~ '^{\"k\": %d+}$' && Hostname =~ 'host[13579]' && Type !~ /^[a-c]/", spark, sf_dir)


@query(_taken("env_version IS NULL AND payload IS NOT NULL AND user_id >= 10 AND user_id <> 20"))
def match_nil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _take("EnvVersion == NIL && Payload != NIL && Fields[user_id] >= 10 && Fields[user_id] != 20", spark, sf_dir)


@query("SELECT event_id AS pos, event_type AS type, round(value, 4) AS value FROM events WHERE event_type = 'purchase' AND value > 250 AND user_id < 50")
def match_map_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    e = e.withColumn("fields", F.array(field("kind", F.col("type")), field("value", F.col("value"), DOUBLE), field("user", F.col("user_id"), DOUBLE)))
    e = e.withColumns({"f_str": strings(F.col("fields")), "f_num": numbers(F.col("fields"))})
    hit = compile_matcher("Fields[kind] == 'purchase'") & (F.col("f_num")["value"] > 250) & (F.col("f_num")["user"] < 50)
    return e.where(hit).select("pos", "type", F.round("value", 4).alias("value"))


# Projections and guards


@query("SELECT event_id AS pos, event_type AS kind, value::DOUBLE AS amount, 1 AS n_fields_left FROM events")
def project_promote_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    e = e.withColumn("fields", F.array(field("kind", F.col("type")), field("amount", F.col("value"), DOUBLE, "USD"), field("user", F.col("user_id"), DOUBLE)))
    e = routing.promote(routing.promote(e, "kind", "kind"), "amount", "amount", DOUBLE)
    return e.select("pos", "kind", "amount", F.size("fields").alias("n_fields_left"))


@query(f"WITH {M} SELECT pos, sha256(pos::VARCHAR) AS uuid, CASE WHEN pos % 3 = 0 THEN 'unknown' ELSE hostname END AS hostname, coalesce(env_version, '1') AS env_version FROM m")
def header_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"uuid": F.lit(None).cast("string"), "hostname": F.when(F.col("pos") % 3 != 0, F.col("hostname"))})
    return routing.header_defaults(e, {"hostname": "unknown", "env_version": "1"}).select("pos", "uuid", "hostname", "env_version")


@query(f"WITH {M} SELECT pos, 'analysis.counter' AS logger, 'edge1' AS hostname FROM m UNION ALL SELECT -1 - pos, logger, hostname FROM m")
def restricted_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    out = routing.restricted(e, "analysis.counter", "edge1")
    free = routing.restricted(e.withColumn("pos", -1 - F.col("pos")), "analysis.counter", "edge1", restrict=False)
    return out.unionByName(free).select("pos", "logger", "hostname")


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE strlen(text) <= 1024")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = routing.size_guard(read(spark, sf_dir, "documents"), 1024, "text")
    return ok.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT doc_id, strlen(text) AS n_bytes, CASE WHEN strlen(text) <= 65536 THEN 'output' ELSE 'message' END AS broken_limit FROM documents WHERE strlen(text) > 1024")
def reject_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = routing.size_guard(read(spark, sf_dir, "documents"), 1024, "text")
    n = F.octet_length("text").cast("long")
    return bad.select("doc_id", n.alias("n_bytes"), F.when(n <= 65536, "output").otherwise("message").alias("broken_limit"))


@query("SELECT 'failed' AS route, event_id AS pos FROM events WHERE event_id % 5 = 0 UNION ALL SELECT 'decoded', event_id FROM events WHERE event_id % 5 <> 0")
def decode_failure_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("payload", F.when(F.col("pos") % 5 == 0, F.lit("broken")).otherwise(F.col("payload")))
    ok, bad = routing.decode_or_route(e, decoders.extract(F.col("payload"), r'^\{"k": (\d+)\}$', 1))
    return ok.select(F.lit("decoded").alias("route"), "pos").unionByName(bad.select(F.lit("failed").alias("route"), "pos"))


@query(f"WITH {M} SELECT pos, CASE severity WHEN 3 THEN 'error' ELSE 'debug' END AS level FROM m WHERE severity <= 6")
def log_level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.at_level(events(spark, sf_dir), 99).select("pos", scalars.severity_name(F.col("severity")).alias("level"))


# Queues, union, fan-out


@query(f"WITH {M} SELECT queue, count(*) AS n, sum(value)::DECIMAL(18,2)::DOUBLE AS total FROM m WHERE queue = 'analysis' GROUP BY ALL")
def queue_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.read_queue(events(spark, sf_dir), "analysis").groupBy("queue").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT 'input.events' AS logger, event_type AS type, count(*) AS n FROM events GROUP BY ALL
UNION ALL SELECT 'input.conversations', role, count(*) FROM conversations GROUP BY ALL UNION ALL SELECT 'input.documents', lang, count(*) FROM documents GROUP BY ALL""")
def multiplex_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = lambda t, kind: read(spark, sf_dir, t).select(F.lit(f"input.{t}").alias("logger"), F.col(kind).alias("type"))
    both = routing.multiplex(stream("events", "event_type"), stream("conversations", "role"), stream("documents", "lang"))
    return both.groupBy("logger", "type").agg(F.count("*").alias("n"))


PLUGINS = {"analysis.all": "TRUE", "analysis.errors": "Type == 'error'", "analysis.rich": "Fields[value] >= 400", "output.odd": "Hostname =~ '[13579]$'"}


@query(f"""WITH {M}, x AS (SELECT 'analysis.all' AS plugin, * FROM m UNION ALL SELECT 'analysis.errors', * FROM m WHERE type = 'error'
UNION ALL SELECT 'analysis.rich', * FROM m WHERE value >= 400 UNION ALL SELECT 'output.odd', * FROM m WHERE regexp_matches(hostname, '[13579]$'))
SELECT plugin, count(*) AS n, sum(pos)::BIGINT AS sum_pos FROM x GROUP BY ALL""")
def fanout_shared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = routing.fan_out(events(spark, sf_dir), {k: compile_matcher(v, PROMOTED) for k, v in PLUGINS.items()})
    return taken.groupBy("plugin").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


@query(f"WITH {M} SELECT 0 AS round, type, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 1, 'alert', count(*) FROM m WHERE type = 'error' AND value > 300 HAVING count(*) > 0")
def feedback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    alert = lambda df: df.where("type = 'error' and value > 300").withColumn("type", F.lit("alert"))
    return routing.feedback(events(spark, sf_dir), alert, depth=1).groupBy("round", "type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events")
def dedup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    return delivery.replayed_once(e.unionByName(e.where("event_id % 10 = 0")), ["event_id"])


# Counters and ticks

CLOCK = f"""{M}, s AS (SELECT *, timestamp_ns // 1000000000 AS sec FROM m), c AS (SELECT *, max(sec) OVER (ORDER BY pos) AS clk FROM s),
d AS (SELECT clk, min(pos) AS pos FROM c GROUP BY clk),
r(clk) AS (SELECT min(clk) FROM d UNION ALL SELECT (SELECT min(d.clk) FROM d WHERE d.clk >= r.clk + {HOUR}) FROM r WHERE r.clk IS NOT NULL),
t AS (SELECT d.clk, d.pos FROM r JOIN d USING (clk)),
w AS (SELECT c.*, c.pos IN (SELECT pos FROM t) AS fires, (SELECT count(*) FROM t WHERE t.pos < c.pos) AS window_id FROM c)"""
LATE = CLOCK.replace("timestamp_ns // 1000000000 AS sec", "timestamp_ns // 1000000000 - (pos % 7) * 3600 AS sec")


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events out of order: each up to six hours older than it says."""
    return events(spark, sf_dir).withColumn("timestamp_ns", F.col("timestamp_ns") - F.col("pos") % 7 * F.lit(3_600_000_000_000))


@query(f"WITH {M} SELECT count(*) AS n, count(*) FILTER (type = 'error') AS n_error FROM m")
def counter_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("type") == "error").alias("n_error"))


@query(f"WITH {M} SELECT type, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM m GROUP BY type")
def counter_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"WITH {M} SELECT pos, type, row_number() OVER (PARTITION BY type ORDER BY pos) AS cnt FROM m")
def counter_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running(events(spark, sf_dir), F.lit(1), "cnt", by=["type"], fold="count").select("pos", "type", "cnt")


@query(LATE.replace("m AS", "WITH RECURSIVE m AS", 1) + " SELECT pos, clk FROM c")
def event_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.clocked(_late(spark, sf_dir)).select("pos", "clk")


@query(CLOCK.replace("m AS", "WITH RECURSIVE m AS", 1) + " SELECT clk, pos FROM t")
def tick_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.triggers(ticks.clocked(events(spark, sf_dir)), HOUR).select("clk", "pos")


_COUNTS = """, g AS (SELECT window_id, max(CASE WHEN fires THEN clk END) AS tick_clk, count(*) AS n_messages, count(*) FILTER (type = 'error') AS n FROM w GROUP BY window_id)
SELECT window_id, tick_clk, tick_clk IS NULL AS is_shutdown, n_messages, n, (sum(n) OVER (ORDER BY window_id))::BIGINT AS n_total FROM g"""


def tick_error_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by hourly ticks: scan, matcher, event clock, fold, counter and shutdown flush."""
    return ticks.tick_counts(ticks.windowed(events(spark, sf_dir), HOUR), compile_matcher("Type == 'error'"))


query(CLOCK.replace("m AS", "WITH RECURSIVE m AS", 1) + _COUNTS)(tick_error_counter)


@query(LATE.replace("m AS", "WITH RECURSIVE m AS", 1) + _COUNTS)
def tick_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.tick_counts(ticks.windowed(_late(spark, sf_dir), HOUR), compile_matcher("Type == 'error'"))


@query(CLOCK.replace("m AS", "WITH RECURSIVE m AS", 1) + _COUNTS.replace("FROM g", "FROM g QUALIFY tick_clk IS NULL").replace("SELECT window_id, tick_clk,", "SELECT window_id,"))
def tick_shutdown_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_error_counter(spark, sf_dir).where("is_shutdown").drop("tick_clk")


@query(CLOCK.replace("m AS", "WITH RECURSIVE m AS", 1) + """, e AS (SELECT window_id, user_id, min(pos) AS first_pos FROM w WHERE type = 'purchase' GROUP BY ALL)
SELECT window_id, user_id, row_number() OVER (PARTITION BY window_id ORDER BY first_pos) <= 3 AS accepted FROM e""")
def tick_inject_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ticks.windowed(events(spark, sf_dir), HOUR)
    emitted = w.where("type = 'purchase'").groupBy("window_id", "user_id").agg(F.min("pos").alias("first_pos"))
    return ticks.emission_limit(emitted, 3, ["window_id"], ["first_pos"]).select("window_id", "user_id", "accepted")


_PLUGIN = """, g AS (SELECT window_id, max(CASE WHEN fires THEN clk END) AS tick_clk, max(clk) AS last_clk, count(*) FILTER (type = 'error') AS n FROM w GROUP BY window_id),
x AS (SELECT coalesce(tick_clk, last_clk) AS clk, (sum(n) OVER (ORDER BY window_id))::BIGINT AS total FROM g)
SELECT clk, total::VARCHAR AS payload FROM x UNION ALL SELECT max(clk), max(total)::VARCHAR FROM x HAVING (SELECT max(pos) FROM w WHERE fires) = (SELECT max(pos) FROM w)"""


@query(CLOCK.replace("m AS", "WITH RECURSIVE m AS", 1) + _PLUGIN)
def plugin_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counting plugin in user code, with its shutdown call."""
    spec = OperatorSpec(kind="analysis", name="analysis.counter", filename="counter.lua", message_matcher="Type == 'error'", ticker_interval=HOUR)
    return plugins.run_plugin(events(spark, sf_dir), spec, plugins.Counter, compile_matcher(spec.message_matcher)).select("clk", "payload")


# Order


@query(LATE.replace("m AS", "WITH RECURSIVE m AS", 1) + """, h AS (SELECT *, max(timestamp_ns - (pos % 7) * 3600000000000) OVER (PARTITION BY queue ORDER BY pos) AS head_ns FROM m)
SELECT pos, queue, row_number() OVER (ORDER BY head_ns, queue = 'analysis', pos) AS seq FROM h""")
def merge_oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.delivery_order(_late(spark, sf_dir)).select("pos", "queue", "seq")


@query(f"WITH {M} SELECT pos, row_number() OVER (ORDER BY pos) AS seq FROM m WHERE queue = 'input'")
def merge_input_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.delivery_order(routing.read_queue(events(spark, sf_dir), "input")).select("pos", "seq")


# Timers

TIMER_SQL = f"""{M}, l AS (SELECT pos, timestamp_ns AS ns, type AS name, CASE WHEN user_id % 2 = 0 THEN 'START_TIMER' ELSE 'END_TIMER' END AS prefix FROM m),
x AS (SELECT *, lag(prefix) OVER (PARTITION BY name ORDER BY pos) AS pv FROM l), k AS (SELECT * FROM x WHERE pv IS NULL OR pv <> prefix),
p AS (SELECT name, pos, prefix, ns - lag(ns) OVER (PARTITION BY name ORDER BY pos) AS delta FROM k)"""


def _timer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a daemon's log: users with even numbers start the timer of the type, the others end it."""
    prefix = F.when(F.col("user_id") % 2 == 0, "START_TIMER").otherwise("END_TIMER")
    line = F.when(F.col("pos") >= 0, F.concat(F.col("timestamp_ns").cast("string"), F.lit(" [debug] input.a_b "), prefix, F.lit(":"), F.col("type")))
    noise = events(spark, sf_dir).where("pos % 50 = 0").select("pos", F.concat(F.col("timestamp_ns").cast("string"), F.lit(" [info] input.a START_TIMER:x")).alias("value"))
    return timers.timer_lines(events(spark, sf_dir).select("pos", line.alias("value")).unionByName(noise))


@query(f"WITH {TIMER_SQL} SELECT name, pos, delta FROM p WHERE prefix = 'END_TIMER' AND delta IS NOT NULL")
def timer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.pairs(_timer_log(spark, sf_dir))


@query(f"WITH {TIMER_SQL} SELECT name, count(*) AS n, min(delta) AS min, max(delta) AS max, round(avg(delta / 1e9), 4) AS avg_s, round(stddev_samp(delta / 1e9), 4) AS sd_s FROM p WHERE prefix = 'END_TIMER' AND delta IS NOT NULL GROUP BY name")
def timer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.report(_timer_log(spark, sf_dir)).select("name", "n", "min", "max", F.round(F.col("avg") / 1e9, 4).alias("avg_s"), F.round(F.col("sd") / 1e9, 4).alias("sd_s"))


# Telemetry

_ROUND = "CASE WHEN {d} = 0 THEN 0 ELSE ({n} * 1000 // {d}) // 10 + CASE WHEN ({n} * 1000 // {d}) % 10 > 5 OR (({n} * 1000 // {d}) % 10 = 5 AND ({n} * 1000 // {d}) // 10 % 2 = 1) THEN 1 ELSE 0 END END"


@query(f"SELECT l_orderkey, l_linenumber, {_ROUND.format(n='l_partkey', d='l_suppkey')} AS percent FROM lineitem")
def round_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.round_percentage(F.col("l_partkey"), F.col("l_suppkey")).alias("percent"))


@query("""SELECT event_id AS pos, greatest(user_id, CASE WHEN event_id % 1000 = 0 OR (event_id * 977) // (event_id % 1000) = 0 THEN 1 ELSE 1000000000 // ((event_id * 977) // (event_id % 1000)) + 1 END, event_id % 1000)::BIGINT AS mps FROM events""")
def max_mps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("pos", scalars.max_rate(F.col("pos") * 977, F.col("pos") % 1000, F.col("user_id")).alias("mps"))


_SAMPLES = f"""{M}, s AS (SELECT *, timestamp_ns // 1000000000 // 6 AS w FROM m)"""


@query(f"WITH {_SAMPLES} SELECT pos, w AS sample_window, pos = min(pos) OVER (PARTITION BY w) AS sampled FROM s")
def sample_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("clk", scalars.seconds(F.col("timestamp_ns")))
    return telemetry.sampled(e).select("pos", "sample_window", "sampled")


@query(f"WITH {M} SELECT type, count(*) AS n, round(avg(value), 4) AS avg, round(coalesce(stddev_samp(value), 0), 4) AS sd FROM m GROUP BY type")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.latency_stats(events(spark, sf_dir), ["type"], "value").select("type", "n", F.round("avg", 4).alias("avg"), F.round("sd", 4).alias("sd"))


_CUM = f"""{M}, g AS (SELECT type, timestamp_ns // 1000000000 // 86400 AS day, count(*) AS n, sum(pos)::BIGINT AS bytes FROM m GROUP BY ALL),
cum AS (SELECT type, day, (sum(n) OVER (PARTITION BY type ORDER BY day))::BIGINT AS n, (sum(bytes) OVER (PARTITION BY type ORDER BY day))::BIGINT AS bytes FROM g)"""


def _cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = events(spark, sf_dir).withColumn("day", F.call_function("div", F.col("timestamp_ns"), F.lit(86_400_000_000_000))).groupBy("type", "day").agg(F.count("*").alias("n"), F.sum("pos").alias("bytes"))
    w = Window.partitionBy("type").orderBy("day")
    return daily.select("type", "day", F.sum("n").over(w).alias("n"), F.sum("bytes").over(w).alias("bytes"))


@query(f"WITH {_CUM} SELECT type, day, n - coalesce(lag(n) OVER x, 0) AS n_delta, bytes - coalesce(lag(bytes) OVER x, 0) AS bytes_delta FROM cum WINDOW x AS (PARTITION BY type ORDER BY day)")
def delta_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.deltas(_cumulative(spark, sf_dir), ["type"], "day", ["n", "bytes"])


@query(f"""WITH {M}, g AS (SELECT type AS plugin, count(*) AS messages, sum(pos)::BIGINT AS mm_ns, sum(pos * 3)::BIGINT AS pm_ns, sum(user_id)::BIGINT AS te_ns, count(*) FILTER (queue = 'input') AS input_delta, 4000 AS max_mps FROM m GROUP BY ALL),
h AS (SELECT *, greatest(messages // 6, input_delta // 6) AS rate, mm_ns + pm_ns + te_ns AS all_ns FROM g)
SELECT plugin, messages, least({_ROUND.format(n='rate', d='max_mps')}, 255)::BIGINT AS utilization, ({_ROUND.format(n='mm_ns', d='all_ns')})::BIGINT AS mm, ({_ROUND.format(n='pm_ns', d='all_ns')})::BIGINT AS pm, ({_ROUND.format(n='te_ns', d='all_ns')})::BIGINT AS te FROM h""")
def utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = events(spark, sf_dir).groupBy(F.col("type").alias("plugin")).agg(
        F.count("*").alias("messages"), F.sum("pos").alias("mm_ns"), F.sum(F.col("pos") * 3).alias("pm_ns"), F.sum("user_id").alias("te_ns"),
        F.count_if(F.col("queue") == "input").alias("input_delta")).withColumn("max_mps", F.lit(4000).cast("long"))
    return telemetry.utilization_report(totals)


@query(f"""WITH {M}, x AS (SELECT type, floor(value * (pos % 100))::BIGINT AS mm, floor(value * 2 * (user_id % 50))::BIGINT AS pm, CASE WHEN pos % 4 = 0 THEN 0 ELSE floor(value * (6.0::DOUBLE / (pos % 4)))::BIGINT END AS te FROM m)
SELECT type, sum(mm)::BIGINT AS mm_ns, sum(pm)::BIGINT AS pm_ns, sum(te)::BIGINT AS te_ns FROM x GROUP BY type""")
def time_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events(spark, sf_dir).select("type", F.col("value").alias("mm_avg"), (F.col("pos") % 100).alias("mm_delta"), (F.col("value") * 2).alias("pm_avg"), (F.col("user_id") % 50).alias("pm_delta"), F.col("value").alias("te_avg"), (F.col("pos") % 4).alias("ticker"))
    return telemetry.time_totals(r, ["type"])


@query(f"WITH {M} SELECT type, max(length(payload)) AS max_output, max(pos) AS max_instructions, count(*) FILTER (value > 480) AS failures FROM m GROUP BY type")
def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("type").agg(F.max(F.length("payload").cast("long")).alias("max_output"), F.max("pos").alias("max_instructions"), F.count_if(F.col("value") > 480).alias("failures"))


# Queues of files

_VARINT = "CASE " + " ".join(f"WHEN {{n}} < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"


@query(f"SELECT doc_id, strlen(text) AS n, ({_VARINT.format(n='strlen(text)')})::INTEGER AS varint, strlen(text) + 4 + {_VARINT.format(n='strlen(text)')} AS frame FROM documents")
def frame_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("n"), scalars.varint_length(n).alias("varint"), scalars.frame_length(n).alias("frame"))


ROLL = 100_000
ROLL_SQL = f"""z AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id AS pos, strlen(text) + 4 + {_VARINT.format(n='strlen(text)')} AS size FROM documents),
roll(k, pos, file_id, "offset", nid, noff) AS (
  SELECT k, pos, 0::BIGINT, 0::BIGINT, CASE WHEN size >= {ROLL} THEN 1 ELSE 0 END::BIGINT, CASE WHEN size >= {ROLL} THEN 0 ELSE size END::BIGINT FROM z WHERE k = 1
  UNION ALL SELECT z.k, z.pos, roll.nid, roll.noff, CASE WHEN roll.noff + z.size >= {ROLL} THEN roll.nid + 1 ELSE roll.nid END, CASE WHEN roll.noff + z.size >= {ROLL} THEN 0 ELSE roll.noff + z.size END
  FROM roll JOIN z ON z.k = roll.k + 1)"""


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.lit("input").alias("queue"), F.col("doc_id").alias("pos"), "text")
    return queues.rolled(docs, ROLL, size=queues.framed_size(F.col("text")))


@query(f"WITH RECURSIVE {ROLL_SQL} SELECT 'input' AS queue, pos, file_id, \"offset\" FROM roll")
def roll_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir)


@query(f"WITH RECURSIVE {ROLL_SQL} SELECT pos, file_id, \"offset\" FROM roll WHERE file_id > 2 OR (file_id = 2 AND \"offset\" >= 5000)")
def resume_from_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scalars.parse_position(F.lit("2:5000"))
    at = spark.range(1).select(p["id"].alias("id"), p["offset"].alias("offset")).first()
    return queues.after_position(_rolled(spark, sf_dir), at["id"], at["offset"]).select("pos", "file_id", "offset")


_IDS = "ids AS (SELECT DISTINCT user_id AS file_id FROM events WHERE user_id % 7 <> 3)"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "events").where("user_id % 7 <> 3").select(F.concat(F.col("user_id").cast("string"), F.lit(".log")).alias("name")).distinct()
    return queues.files(names.unionByName(spark.createDataFrame([("x.log",), ("12.log.tmp",), (".log",)], "name string")))


@query(f"WITH {_IDS} SELECT file_id, lead(file_id) OVER (ORDER BY file_id) AS next_id, lead(file_id) OVER (ORDER BY file_id) - file_id - 1 AS skipped FROM ids")
def find_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.next_ids(_ids(spark, sf_dir))


@query(f"WITH {_IDS} SELECT min(file_id) AS first_id, max(file_id) AS last_id, count(*) AS n_files FROM ids")
def first_last_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.first_last(_ids(spark, sf_dir))


@query("SELECT c_custkey AS reader, CASE WHEN c_custkey % 100 > 60 THEN 99 ELSE c_nationkey END::BIGINT AS file_id, CASE WHEN c_custkey % 100 > 60 THEN 7 ELSE c_custkey END AS \"offset\", c_custkey % 100 > 60 AS was_reset FROM customer")
def position_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return queues.reset_positions(c.select(F.col("c_custkey").alias("reader"), F.col("c_nationkey").cast("long").alias("file_id"), F.col("c_custkey").alias("offset"), (F.col("c_custkey") % 100).alias("tries"), F.lit(99).cast("long").alias("writer_id"), F.lit(7).cast("long").alias("writer_offset")))


@query("SELECT n_name AS queue, min(c_custkey) AS min_id FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def low_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return queues.low_water_marks(c.select(F.col("n_name").alias("queue"), F.col("c_custkey").alias("file_id")))


@query("SELECT o_orderkey AS step, o_custkey - o_orderkey % 97 > 50 AS lagging, o_orderkey % 9 <= 4 AS full, false AS off FROM orders")
def backpressure_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("step"), queues.over_lag(F.col("o_custkey"), F.col("o_orderkey") % 97, 50).alias("lagging"), queues.over_disk(F.col("o_orderkey") % 9, 4).alias("full"), queues.over_lag(F.col("o_custkey"), F.lit(0), 0).alias("off"))


@query("""WITH RECURSIVE z AS (SELECT row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, event_type AS queue, event_id AS step, user_id % 3 = 0 AS roll, user_id % 10 + 5 AS writer_id, event_id % 12 AS min_id, event_id % 8 AS free FROM events),
h(k, queue, step, throttled) AS (SELECT k, queue, step, roll AND (writer_id - min_id > 4 OR free <= 1) FROM z WHERE k = 1
 UNION ALL SELECT z.k, z.queue, z.step, CASE WHEN roll THEN throttled OR writer_id - min_id > 4 OR free <= 1 ELSE throttled AND NOT (writer_id = min_id AND free > 1) END FROM h JOIN z ON z.queue = h.queue AND z.k = h.k + 1)
SELECT queue, step, throttled FROM h""")
def backpressure_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    steps = e.select(F.col("event_type").alias("queue"), F.col("event_id").alias("step"), F.when(F.col("user_id") % 3 == 0, "roll").otherwise("check").alias("kind"), (F.col("user_id") % 10 + 5).alias("writer_id"), (F.col("event_id") % 12).alias("min_id"), (F.col("event_id") % 8).alias("free"))
    return queues.backpressure(steps, lag=4, disk=1)


# Delivery


def _acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("plugin"), F.col("event_id").alias("pos"), ((F.col("user_id") % 40 != 0) & (F.col("event_id") < 900)).alias("acked"))


_ACKS = "a AS (SELECT event_type AS plugin, event_id AS pos, user_id % 40 <> 0 AND event_id < 900 AS acked FROM events)"


@query(f"WITH {_ACKS} SELECT plugin, max(pos) AS cp FROM a WHERE acked GROUP BY plugin")
def async_commit_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.commit_latest(_acks(spark, sf_dir), ["plugin"])


@query(f"WITH {_ACKS}, g AS (SELECT plugin, min(pos) FILTER (NOT acked) AS gap FROM a GROUP BY plugin) SELECT plugin, max(pos) AS cp FROM a JOIN g USING (plugin) WHERE gap IS NULL OR pos < gap GROUP BY plugin")
def async_commit_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.commit_contiguous(_acks(spark, sf_dir), ["plugin"])


_CODES = "CASE WHEN event_id % 4001 = 4000 THEN 1 WHEN user_id % 9 = 0 THEN 0 WHEN user_id % 9 = 1 THEN -1 WHEN user_id % 9 = 2 THEN -4 WHEN user_id % 9 = 3 THEN -5 WHEN user_id % 9 = 4 THEN NULL ELSE -2 END"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 9
    code = F.when(F.col("event_id") % 4001 == 4000, 1).when(k == 0, 0).when(k == 1, -1).when(k == 2, -4).when(k == 3, -5).when(k == 4, F.lit(None)).otherwise(-2)
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("plugin"), F.col("event_id").alias("pos"), code.alias("code"), (F.col("event_id") % 499 != 77).alias("acked"))


@query(f"""WITH r AS (SELECT event_type AS plugin, event_id AS pos, {_CODES} AS code, event_id % 499 <> 77 AS acked FROM events),
e AS (SELECT plugin, min(pos) AS stop FROM r WHERE code > 0 OR (code = -5 AND NOT acked) GROUP BY plugin),
h AS (SELECT r.*, coalesce(pos >= stop, false) AS ended,
             coalesce(last_value(CASE code WHEN -4 THEN 1 WHEN 0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY plugin ORDER BY pos), 0) = 1 AS held FROM r LEFT JOIN e USING (plugin)),
c AS (SELECT *, NOT ended AND (coalesce(code = -5, false) OR (NOT held AND coalesce(code NOT IN (-4, -3), true))) AS commits FROM h)
SELECT plugin, pos, commits, max(CASE WHEN commits THEN pos END) OVER (PARTITION BY plugin ORDER BY pos) AS cp FROM c""")
def batch_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.committed(_results(spark, sf_dir), ["plugin"], acked="acked").select("plugin", "pos", "commits", "cp")


@query(f"WITH r AS (SELECT event_type AS plugin, event_id AS pos, {_CODES} AS code FROM events) SELECT plugin, count(*) AS n_lost, max(pos) AS last_pos FROM r WHERE code = -1 GROUP BY plugin")
def fail_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.dead_letters(_results(spark, sf_dir)).groupBy("plugin").agg(F.count("*").alias("n_lost"), F.max("pos").alias("last_pos"))


@query("SELECT user_id AS message, count(*) AS tries, arg_max(CASE WHEN value > 250 THEN -3 ELSE 0 END, event_id) AS code, arg_max(value, event_id) > 250 AS still_blocked FROM events GROUP BY user_id")
def retry_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "events").select(F.col("user_id").alias("message"), F.col("event_id").alias("attempt"), F.when(F.col("value") > 250, delivery.RETRY).otherwise(delivery.SENT).alias("code"))
    return delivery.attempts(r, ["message"])


@query("SELECT event_type AS plugin, min(event_id) AS pos FROM events WHERE value > 485 GROUP BY event_type")
def fatal_terminates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "events").select(F.col("event_type").alias("plugin"), F.col("event_id").alias("pos"), F.when(F.col("value") > 485, 1).otherwise(0).alias("code"))
    return delivery.terminated(r, ["plugin"])


@query("SELECT event_id AS pos, event_id % 999 AS slot FROM events")
def async_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), delivery.ring_slot(F.col("event_id"), 999).alias("slot"))


# Checkpoints and control


@query("""WITH r AS (SELECT 'output.c' || c_custkey AS reader, CASE WHEN c_nationkey % 2 = 0 THEN 'input' ELSE 'analysis' END AS queue, c_acctbal > 0 AS from_files, c_custkey AS k FROM customer)
SELECT reader, queue, (CASE WHEN k % 3 = 0 THEN k ELSE CASE WHEN from_files AND queue = 'input' THEN 4 ELSE CASE queue WHEN 'input' THEN 40 ELSE 50 END END END)::BIGINT AS id,
 (CASE WHEN k % 3 = 0 THEN k * 10 ELSE CASE WHEN from_files AND queue = 'input' THEN 0 ELSE CASE queue WHEN 'input' THEN 400 ELSE 500 END END END)::BIGINT AS "offset",
 CASE WHEN k % 3 = 0 THEN 'checkpoint' WHEN from_files AND queue = 'input' THEN 'first file' ELSE 'writer' END AS origin FROM r""")
def checkpoint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    queue = F.when(F.col("c_nationkey") % 2 == 0, "input").otherwise("analysis")
    reader = F.concat(F.lit("output.c"), F.col("c_custkey").cast("string"))
    readers = c.select(reader.alias("reader"), queue.alias("queue"), (F.col("c_acctbal") > 0).alias("from_files"))
    saved = c.where("c_custkey % 3 = 0").select(F.concat(queue, F.lit("->"), reader).alias("key"), scalars.format_position(F.col("c_custkey"), F.col("c_custkey") * 10).alias("value"))
    firsts = spark.createDataFrame([("input", 4)], "queue string, first_id long")
    writers = spark.createDataFrame([("input", 40, 400), ("analysis", 50, 500)], "queue string, writer_id long, writer_offset long")
    return checkpoints.lookup(readers, saved, firsts, writers)


@query("""WITH k AS (SELECT 'input->output.c' || c_custkey AS key, c_custkey % 2 = 0 AS keep FROM customer UNION ALL SELECT 'input->analysis' || n_nationkey, n_nationkey < 4 FROM nation
UNION ALL SELECT 'input.c' || c_custkey, c_custkey % 2 = 0 AND c_custkey % 5 = 0 FROM customer UNION ALL SELECT 'input', true UNION ALL SELECT 'analysis', true) SELECT key, '1:2' AS value FROM k WHERE keep""")
def checkpoint_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string")).alias("key")
    keys = c.select(key("input->output.c", "c_custkey")).union(n.select(key("input->analysis", "n_nationkey"))).union(c.select(key("input.c", "c_custkey"))).union(spark.createDataFrame([("input",), ("analysis",)], "key string"))
    plugins = c.where("c_custkey % 2 = 0").select(key("output.c", "c_custkey")).union(c.where("c_custkey % 10 = 0").select(key("input.c", "c_custkey"))).toDF("name")
    return checkpoints.cleanup(keys.withColumn("value", F.lit("1:2")), plugins, threads=4)


@query("SELECT c_custkey AS plugin, 'm' || c_nationkey || '.lua' AS filename FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def restart_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = lambda col: F.concat(F.lit("m"), F.col(col).cast("string"), F.lit(".lua")).alias("filename")
    plugins = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plugin"), file("c_nationkey"))
    return checkpoints.using_code(plugins, read(spark, sf_dir, "nation").where("n_regionkey = 2").select(file("n_nationkey"))).select("plugin", "filename")


@query("""SELECT l_orderkey % 50 AS run, (sum(DISTINCT CASE WHEN l_returnflag = 'R' AND l_quantity > 48 THEN 2 WHEN l_returnflag = 'A' AND l_quantity > 49 THEN 4 WHEN l_returnflag = 'N' AND l_quantity > 49 THEN 8 ELSE 0 END))::BIGINT AS exit_code FROM lineitem GROUP BY 1""")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.lifecycle import exit_codes

    q = F.col("l_quantity")
    li = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("run"), F.when((F.col("l_returnflag") == "R") & (q > 48), "input").when((F.col("l_returnflag") == "A") & (q > 49), "analysis").when((F.col("l_returnflag") == "N") & (q > 49), "output").alias("failed"))
    return exit_codes(li, "run", "failed")


@query("SELECT event_id AS pos, n_name AS nation_name, r_name AS nation_region FROM events LEFT JOIN nation ON user_id % 40 = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def enrich_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("nation"))
    table = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return routing.enrich(e, table, "nation", "n_nationkey", {"name": "n_name", "region": "r_name"}).select(F.col("event_id").alias("pos"), "nation_name", "nation_region")


# Decoders


@query(f"WITH {M} SELECT pos, (timestamp_ns // 1000000000) * 1000000000 AS timestamp_ns, hostname, type AS programname, (pos % 1000 + 1)::INTEGER AS pid, payload AS msg FROM m")
def decode_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    stamp = F.date_format(F.timestamp_seconds(scalars.seconds(F.col("timestamp_ns"))), "MMM dd HH:mm:ss")
    line = F.concat(stamp, F.lit(" "), F.col("hostname"), F.lit(" "), F.col("type"), F.lit("["), (F.col("pos") % 1000 + 1).cast("string"), F.lit("]: "), F.col("payload"))
    return e.select("pos", decoders.syslog(line, 2024).alias("d")).select("pos", "d.*")


@query("SELECT event_id AS pos, 'conf/' || event_type AS path, user_id::DOUBLE AS linenum FROM events")
def decode_printf(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("conf/"), F.col("event_type"), F.lit(":"), F.col("user_id").cast("string"), F.lit(": invalid line"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), decoders.printf(line, "%s:%lu: invalid line", ["path", "linenum"]).alias("d")).select("pos", "d.*")


@query("SELECT event_id AS pos, event_type AS kind, 'say \"' || user_id || '\"' AS note, true AS debug, user_id::VARCHAR AS id FROM events")
def decode_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("kind="), F.col("event_type"), F.lit(' note="say \\"'), F.col("user_id").cast("string"), F.lit('\\"" debug id%x='), F.col("user_id").cast("string"))
    pick = lambda name, cell: F.get(F.filter("d", lambda f: f["name"] == name), F.lit(0))[cell]
    decoded = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), decoders.logfmt(line).alias("d"))
    return decoded.select("pos", pick("kind", "value").alias("kind"), pick("note", "value").alias("note"), pick("debug", "flag").alias("debug"), pick("id%x", "value").alias("id"))


NGINX = '$remote_addr $msec "$request" $status $body_bytes_sent "$http_referer" "$http_user_agent" "$http_x_forwarded_for"'


def nginx_lines(e: DataFrame) -> DataFrame:
    """Events as access-log lines in the format NGINX."""
    text = lambda c: F.col(c).cast("string")
    ms = F.call_function("div", micros(F.col("ts")), F.lit(1000).cast("long"))
    seconds = F.concat(F.call_function("div", ms, F.lit(1000).cast("long")).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return e.select("event_id", F.concat(F.lit("10.0.0."), text("user_id"), F.lit(" "), seconds, F.lit(' "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" '),
                                         (F.col("user_id") % 5 * 100 + 100).cast("string"), F.lit(" "), text("event_id"), F.lit(' "-" "agent/1.0 (x)" "-"')).alias("line"))


@query("SELECT event_id AS pos, '10.0.0.' || user_id AS remote_addr, (epoch_us(ts) // 1000) * 1000000 AS timestamp_ns, 'GET /' || event_type || ' HTTP/1.1' AS request, (user_id % 5 * 100 + 100)::DOUBLE AS status, event_id::DOUBLE AS body_bytes_sent, '-' AS http_referer, 'agent/1.0 (x)' AS http_user_agent, '-' AS http_x_forwarded_for FROM events")
def decode_nginx(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = nginx_lines(read(spark, sf_dir, "events"))
    decoded = decoders.decode_access(lines.select(F.col("event_id").alias("pos"), "line"), "line", NGINX)
    return decoded.withColumn("timestamp_ns", decoders.seconds_ns(F.col("msec"))).drop("line", "msec")


@query("SELECT event_id AS pos, CASE event_type WHEN 'error' THEN 'E' || user_id WHEN 'view' THEN 'V' || user_id ELSE 'other' END AS decoded FROM events")
def sub_decoder_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), decoders.dispatch(F.col("event_type"), {"error": tag("E"), "view": tag("V")}, F.lit("other")).alias("decoded"))


# Scalars

@query("SELECT doc_id, replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), '\"', '\\\"') AS escaped, lang || '.' || source AS plugin, source || '/' || lang AS path FROM documents")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", scalars.escape_string(F.col("text")).alias("escaped"), scalars.plugin_name(F.col("lang"), F.concat("source", F.lit(".cfg"))).alias("plugin"), scalars.join_path(F.col("source"), F.col("lang")).alias("path"))


@query(f"WITH {M} SELECT pos, strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%S') AS at, timestamp_ns // 1000000000 AS sec, CASE WHEN user_id % 4 = 0 THEN 0 ELSE pos * 1000 // (user_id % 4) END AS units, timestamp_ns || ' [' || CASE severity WHEN 3 THEN 'error' ELSE 'debug' END || '] output.' || type || ' ' || payload AS line FROM m")
def time_and_log_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("pos", scalars.utc_second(F.call_function("div", F.col("timestamp_ns"), F.lit(1000).cast("long"))).alias("at"), scalars.seconds(F.col("timestamp_ns")).alias("sec"),
                    scalars.free_units(F.col("pos") * 1000, F.col("user_id") % 4).alias("units"), scalars.log_line(F.col("timestamp_ns"), F.col("severity"), F.concat(F.lit("output."), F.col("type")), F.col("payload")).alias("line"))


@query("SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END)::BIGINT AS id, (CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END)::BIGINT AS \"offset\" FROM orders")
def position_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, scalars.format_position(F.col("o_custkey"), F.col("o_orderkey"))).otherwise("not:a:position")
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.parse_position(text).alias("p")).select("o_orderkey", "p.id", "p.offset")


@query("SELECT l_orderkey, l_linenumber, printf('%g', l_quantity * 1.5) AS plain, printf('%g', l_quantity / 1e7) AS small, printf('%g', l_partkey * 1e4) AS large FROM lineitem")
def general_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scalars.general_number
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", g(F.col("l_quantity") * 1.5).alias("plain"), g(F.col("l_quantity") / 1e7).alias("small"), g(F.col("l_partkey") * 1e4).alias("large"))


# Uses that the stream's documentation names, of our own design


@query(f"""WITH {M}, s AS (SELECT *, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY user_id ORDER BY pos) > 1800000000000 AS gap FROM m),
g AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS session FROM s)
SELECT user_id, session::BIGINT AS session, count(*) AS n, max(timestamp_ns) - min(timestamp_ns) AS span_ns FROM g GROUP BY ALL""")
def sessionize_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("pos")
    gap = (F.col("timestamp_ns") - F.lag("timestamp_ns").over(w)) > 1_800_000_000_000
    s = events(spark, sf_dir).withColumn("gap", F.coalesce(gap, F.lit(False)).cast("long")).withColumn("session", F.sum("gap").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("timestamp_ns") - F.min("timestamp_ns")).alias("span_ns"))


@query(f"""WITH {M}, h AS (SELECT type, timestamp_ns // 3600000000000 AS hour, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT type, avg(n) AS mean, stddev_samp(n) AS sd FROM h GROUP BY type)
SELECT type, hour, n, round((n - mean) / sd, 4) AS z FROM h JOIN s USING (type) WHERE abs((n - mean) / sd) > 2""")
def anomaly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = events(spark, sf_dir).groupBy("type", F.call_function("div", F.col("timestamp_ns"), F.lit(3_600_000_000_000)).alias("hour")).agg(F.count("*").alias("n"))
    s = h.groupBy("type").agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))
    z: Column = (F.col("n") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return h.join(s, "type").withColumn("z", z).where("abs(z) > 2").select("type", "hour", "n", F.round("z", 4).alias("z"))
