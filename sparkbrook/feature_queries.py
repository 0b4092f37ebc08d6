"""More queries over the stream's features: line sources, common logs, wall-clock timers, reports and encoders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cookbook, decoders, encoders, scalars
from .operators import checkpoints, queues, telemetry, ticks
from .plans import placement
from .queries import query
from .schema import events, micros, read
from .sources import sinks, text_files


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``, on one machine a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{known.rstrip('/')}/{uuid.uuid4().hex}" if known else f"file://{tempfile.mkdtemp(prefix='sparkbrook-')}/lines"


_EVENT = "event_id AS pos, event_type AS type, user_id, value, epoch_us(ts) AS us"


@query("""WITH l AS (SELECT c_nationkey::BIGINT AS nation, c_custkey, c_custkey || ' é ' || c_name AS value FROM customer)
SELECT nation, value, row_number() OVER w - 1 AS pos, (coalesce(sum(strlen(value) + 1) OVER (PARTITION BY nation ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset"
FROM l WINDOW w AS (PARTITION BY nation ORDER BY c_custkey)""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as lines, a file for each nation, and read again with the place of each line."""
    c, folder = read(spark, sf_dir, "customer"), scratch(spark)
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(" é "), F.col("c_name")).alias("value")
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select(line, F.col("c_nationkey").alias("nation")).write.partitionBy("nation").text(folder)
    lines = text_files.lines_with_offsets(spark, folder)
    return lines.select(F.regexp_extract("path", r"nation=(\d+)/", 1).cast("long").alias("nation"), "value", "pos", "offset")


@query("""WITH l AS (SELECT c_nationkey::BIGINT AS nation, c_custkey, c_name FROM customer),
r AS (SELECT nation, c_custkey, c_name, sum(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY nation ORDER BY c_custkey) AS n FROM l)
SELECT nation, string_agg(CASE WHEN c_custkey % 3 = 0 THEN '@' ELSE '' END || c_name, chr(10) ORDER BY c_custkey) AS record FROM r WHERE n > 0 GROUP BY nation, n""")
def multiline_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that begin at lines with a mark, in a file for each nation."""
    c, folder = read(spark, sf_dir, "customer"), scratch(spark)
    line = F.concat(F.when(F.col("c_custkey") % 3 == 0, "@").otherwise(""), F.col("c_name")).alias("value")
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select(line, F.col("c_nationkey").alias("nation")).write.partitionBy("nation").text(folder)
    return text_files.multiline(spark, folder, "^@").select(F.regexp_extract("path", r"nation=(\d+)/", 1).cast("long").alias("nation"), "record")


@query("SELECT c_nationkey::VARCHAR AS queue, min(c_custkey) AS first_id, max(c_custkey) AS last_id, count(*) AS n_files FROM customer WHERE c_custkey % 4 <> 1 GROUP BY 1")
def latest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last file of each queue among directory entries, some of which are no queue files."""
    c = read(spark, sf_dir, "customer")
    name = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 == 1, ".tmp").otherwise(".log"))
    entries = c.select(F.col("c_nationkey").cast("string").alias("queue"), scalars.file_id(name).alias("file_id")).where("file_id is not null")
    return queues.first_last(entries, ["queue"])


@query("SELECT doc_id, n_chars % 2 = 0 AS is_cfg FROM documents")
def extension_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("plugin"), F.col("doc_id").cast("string"), F.when(F.col("n_chars") % 2 == 0, ".cfg").otherwise(".cfg.off"))
    return d.select("doc_id", scalars.has_extension(name, ".cfg").alias("is_cfg"))


@query("SELECT event_id AS pos, upper(event_type) AS event_type, user_id * 2 AS user_id, value FROM events")
def field_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields replaced by functions of themselves; a name that isn't there is passed over."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "event_type", "user_id", "value")
    return decoders.transform_fields(e, {"event_type": F.upper, "user_id": lambda c: c * 2, "missing": F.lower})


@query("""WITH t AS (SELECT range AS tick FROM range(0, (SELECT (40000 - (100 + 17)) // 300 + 2)::BIGINT)),
a AS (SELECT least(greatest(ceil((100 + event_id * 3 - 117) / 300.0), 0), (40000 - 117) // 300 + 1)::BIGINT AS tick FROM events), c AS (SELECT tick, count(*) AS n FROM a GROUP BY tick)
SELECT t.tick, CASE WHEN t.tick <= (40000 - 117) // 300 THEN t.tick * 300 + 117 END AS tick_clk, coalesce(n, 0) AS n, (sum(coalesce(n, 0)) OVER (ORDER BY t.tick))::BIGINT AS n_total FROM t LEFT JOIN c USING (tick)""")
def wall_clock_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at the ticks of a wall clock that runs on while nothing comes in; the first one 17 seconds after the start."""
    e = read(spark, sf_dir, "events")
    return ticks.wall_ticks(e, F.col("event_id") * 3 + 100, 300, start=100, end=40_000, stagger=17)


@query(f"""SELECT pos, (us // 1000000) * 1000000000 AS timestamp_ns, type AS level, (user_id + 1)::INTEGER AS pid, user_id AS tid, CASE WHEN pos % 2 = 0 THEN pos END AS connection,
 'open() "/x" failed (2: none)' AS msg, CASE WHEN pos % 2 = 0 THEN '10.0.0.' || user_id END AS client, CASE WHEN pos % 2 = 0 THEN 'GET /a,b HTTP/1.1' END AS request FROM (SELECT {_EVENT} FROM events)""")
def decode_nginx_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    text = lambda c: c.cast("string")
    at, user, even = F.timestamp_seconds(scalars.seconds(micros(F.col("ts")) * 1000)), F.col("user_id"), F.col("event_id") % 2 == 0
    line = F.concat(F.date_format(at, "yyyy/MM/dd HH:mm:ss"), F.lit(" ["), F.col("event_type"), F.lit("] "), text(user + 1), F.lit("#"), text(user), F.lit(": "),
                    F.when(even, F.concat(F.lit("*"), text(F.col("event_id")), F.lit(" "))).otherwise(""), F.lit('open() "/x" failed (2: none)'),
                    F.when(even, F.concat(F.lit(", client: 10.0.0."), text(user), F.lit(', server: s, request: "GET /a,b HTTP/1.1", host: "h"'))).otherwise(""))
    return e.select(F.col("event_id").alias("pos"), cookbook.nginx_error(line).alias("d")).select("pos", "d.timestamp_ns", "d.level", "d.pid", "d.tid", "d.connection", "d.msg", "d.client", "d.request")


@query(f"SELECT pos, type, (us // 1000) * 1000000 AS timestamp_ns, pos AS serial, user_id::VARCHAR AS uid, 'a b' AS comm FROM (SELECT {_EVENT} FROM events)")
def decode_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.call_function("div", micros(F.col("ts")), F.lit(1000).cast("long"))
    line = F.concat(F.lit("type="), F.col("event_type"), F.lit(" msg=audit("), F.call_function("div", ms, F.lit(1000).cast("long")).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit(":"),
                    F.col("event_id").cast("string"), F.lit("): uid="), F.col("user_id").cast("string"), F.lit(' comm="a b" key'))
    pick = lambda n: F.get(F.filter(F.col("d.fields"), lambda f: f["name"] == n), F.lit(0))["value"].alias(n)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), cookbook.audit(line).alias("d")).select("pos", "d.type", "d.timestamp_ns", "d.serial", pick("uid"), pick("comm"))


@query("""SELECT event_id AS pos, event_id AS rule, CASE WHEN user_id % 2 = 0 THEN 'pass' ELSE 'block' END AS action, (CASE WHEN user_id % 3 = 0 THEN 6 ELSE 4 END)::INTEGER AS version,
CASE WHEN user_id % 5 = 0 THEN 'udp' ELSE 'tcp' END AS protocol, '10.0.0.' || user_id AS source, (user_id + 1000)::INTEGER AS source_port, 443::INTEGER AS destination_port FROM events""")
def decode_packet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, six = F.col("user_id"), F.col("user_id") % 3 == 0
    text = lambda c: c.cast("string")
    protocol = F.when(user % 5 == 0, "udp").otherwise("tcp")
    head = F.concat(text(F.col("event_id")), F.lit(",,,7,em0,match,"), F.when(user % 2 == 0, "pass").otherwise("block"), F.lit(",in,"))
    v4 = F.concat(F.lit("4,0x0,,64,1,0,DF,6,"), protocol, F.lit(",60,"))
    v6 = F.concat(F.lit("6,0x00,0x00000,255,"), protocol, F.lit(",6,60,"))
    tail = F.concat(F.lit("10.0.0."), text(user), F.lit(",10.1.1.1,"), text(user + 1000), F.lit(",443,0"))
    line = F.concat(head, F.when(six, v6).otherwise(v4), tail)
    d = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), cookbook.packet_filter(line).alias("d"))
    return d.select("pos", "d.rule", "d.action", "d.version", "d.protocol", "d.source", "d.source_port", "d.destination_port")


@query("""SELECT o_orderkey, 'u' || o_custkey AS "user", 'db' AS host, (o_custkey % 100) / 8.0::DOUBLE AS query_time, o_custkey % 10 AS rows_sent, o_orderkey * 1000000000 AS timestamp_ns,
'SELECT ' || o_custkey || chr(10) || 'FROM t' AS query FROM orders""")
def decode_slow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    record = F.concat(F.lit("# User@Host: u"), text("o_custkey"), F.lit("[u] @ db [10.0.0.1]\n# Query_time: "), text((F.col("o_custkey") % 100) / 8), F.lit("  Lock_time: 0.5 Rows_sent: "),
                      text(F.col("o_custkey") % 10), F.lit("  Rows_examined: 9\nSET timestamp="), text("o_orderkey"), F.lit(";\nSELECT "), text("o_custkey"), F.lit("\nFROM t;\n"))
    d = o.select("o_orderkey", cookbook.slow_query(record).alias("d"))
    return d.select("o_orderkey", "d.user", "d.host", "d.query_time", "d.rows_sent", "d.timestamp_ns", "d.query")


@query("""SELECT event_id AS pos, event_id || chr(9) || replace(props, '\\', '\\\\') || chr(9) AS tsv, '<tr><td>' || event_type || '</td><td>' || replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</td></tr>' AS html,
'event_type: ' || event_type || ' user_id: ' || user_id AS txt FROM events""")
def text_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("none", F.lit(None).cast("string"))
    return e.select(F.col("event_id").alias("pos"), encoders.tsv(["event_id", "props", "none"]).alias("tsv"), encoders.html_row(["event_type", "props"]).alias("html"), encoders.txt(["event_type", "user_id"]).alias("txt"))


@query("""WITH c AS (SELECT 'analysis.' || event_type AS "Plugin", user_id % 3 AS kind, user_id % 7 = 0 AS failed, strlen(props) AS bytes, event_id, user_id, value FROM events)
SELECT "Plugin", count(*) FILTER (kind = 0) AS "Inject Message Count", (coalesce(sum(bytes) FILTER (kind = 0), 0))::BIGINT AS "Inject Message Bytes", count(*) FILTER (kind = 1) AS "Process Message Count",
 count(*) FILTER (kind = 1 AND failed) AS "Process Message Failures", arg_max(user_id, event_id) AS "Current Memory", max(user_id) AS "Max Memory", max(bytes)::BIGINT AS "Max Output", max(event_id) AS "Max Instructions",
 0::BIGINT AS "Message Matcher Avg (ns)", 0::BIGINT AS "Message Matcher SD (ns)", (coalesce(floor(avg(value * 100) FILTER (kind = 1)), 0))::BIGINT AS "Process Message Avg (ns)",
 (coalesce(floor(stddev_samp(value * 100) FILTER (kind = 1)), 0))::BIGINT AS "Process Message SD (ns)", (coalesce(floor(avg(value * 100) FILTER (kind = 2)), 0))::BIGINT AS "Timer Event Avg (ns)",
 (coalesce(floor(stddev_samp(value * 100) FILTER (kind = 2)), 0))::BIGINT AS "Timer Event SD (ns)" FROM c GROUP BY "Plugin\"""")
def plugins_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen columns of the plugin report from measured calls."""
    kind = F.element_at(F.array(F.lit("inject"), F.lit("process"), F.lit("timer")), (F.col("user_id") % 3 + 1).cast("int"))
    calls = read(spark, sf_dir, "events").select(
        F.concat(F.lit("analysis."), "event_type").alias("plugin"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("user_id") % 7 == 0, -1).otherwise(0).alias("code"), F.octet_length("props").cast("long").alias("bytes"),
        F.col("user_id").alias("memory"), F.octet_length("props").cast("long").alias("output"), F.col("event_id").alias("instructions"), (F.col("value") * 100).alias("ns"))
    return telemetry.plugin_report(calls)


@query("SELECT 'output.' || event_type || event_id AS plugin, strftime(ts, '%Y-%m-%dT%H:%M:%S') || chr(9) || 'process_message returned ' || user_id AS value FROM events WHERE user_id % 5 = 0")
def termination_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("user_id % 5 = 0")
    ended = e.select(F.concat(F.lit("output."), "event_type", F.col("event_id").cast("string")).alias("plugin"), micros(F.col("ts")).alias("at_us"), F.concat(F.lit("process_message returned "), F.col("user_id").cast("string")).alias("error"))
    return sinks.termination_records(ended)


@query("""SELECT event_id AS pos, 'count: ' || count(*) OVER (PARTITION BY event_type ORDER BY event_id) || chr(9) || event_type AS line FROM events""")
def debug_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a debugging output prints: the running count of each type."""
    from .operators.running import running

    counted = running(events(spark, sf_dir), F.lit(1), "n", by=["type"], fold="count")
    return counted.select("pos", F.concat(F.lit("count: "), F.col("n").cast("string"), F.lit("\t"), "type").alias("line"))


@query("""SELECT o_orderkey, '_G["output.' || o_custkey || '"] = ' || CASE WHEN o_orderkey % 2 = 0 THEN printf('%.17g', o_totalprice / 3) ELSE '"' || o_orderkey || ':7"' END AS line FROM orders""")
def checkpoint_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the checkpoint file."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("output."), F.col("o_custkey").cast("string")).alias("key"), F.when(k % 2 == 1, F.concat(k.cast("string"), F.lit(":7"))).alias("value"),
                                             F.when(k % 2 == 0, F.col("o_totalprice").cast("double") / 3).alias("number"), k.alias("o_orderkey"))
    line = checkpoints.text_line()
    return o.select("o_orderkey", line.alias("line"))


# Placement and code


@query("""WITH t AS (SELECT c_nationkey AS engine, c_custkey % 8 AS thread, count(*) AS plugins, (sum(c_custkey) % 100)::BIGINT AS utilization FROM customer GROUP BY ALL),
b AS (SELECT engine, min(utilization) AS u, arg_min(thread, utilization * 100000000 + plugins * 1000 + thread) AS thread FROM t GROUP BY engine)
SELECT engine, CASE WHEN u < 40 THEN thread END AS thread, u >= 40 AS blocked FROM b""")
def placement_least_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    threads = c.groupBy(F.col("c_nationkey").alias("engine"), (F.col("c_custkey") % 8).alias("thread")).agg(F.count("*").alias("plugins"), (F.sum("c_custkey") % 100).alias("utilization"))
    return placement.least_used_threads(threads, ["engine"], 40)


@query("""WITH p AS (SELECT c_custkey AS plugin, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 7 END AS asked, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 END AS running_on, CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 2 END AS least_used FROM customer),
r AS (SELECT *, (running_on IS NOT NULL AND asked IS NOT NULL AND asked % 4 <> running_on) OR (running_on IS NULL AND asked IS NULL AND least_used IS NULL) AS refused FROM p)
SELECT plugin, refused, (CASE WHEN NOT refused THEN coalesce(running_on, asked % 4, least_used) END)::BIGINT AS "on" FROM r""")
def placement_at_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugin goes where it asks or to the least used thread; a running one never moves."""
    k = F.col("c_custkey")
    plugins = read(spark, sf_dir, "customer").select(k.alias("plugin"), F.when(k % 3 > 0, k * 7).alias("asked"), F.when(k % 5 == 0, k % 4).alias("running_on"), F.when(k % 11 > 0, k % 2).alias("least_used"))
    return placement.placed_at_load(plugins, F.lit(4)).select("plugin", "refused", F.col("on").cast("long").alias("on"))


@query("""SELECT c_custkey AS thread, greatest(least(c_custkey % 256 + 5 * (c_custkey % 3), 255) - 5 * (c_custkey % 2), 0)::BIGINT AS utilization,
CASE WHEN c_custkey % 3 + c_custkey % 2 > 0 THEN 0 ELSE c_custkey END AS max_mps FROM customer""")
def placement_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    threads = read(spark, sf_dir, "customer").select(k.alias("thread"), (k % 256).alias("utilization"), k.alias("max_mps"))
    return placement.adjusted_utilization(threads, F.col("thread") % 3, F.col("thread") % 2).select("thread", F.col("utilization").cast("long").alias("utilization"), F.col("max_mps").cast("long").alias("max_mps"))


@query("""SELECT c_custkey AS plugin, CASE WHEN c_nationkey % 3 = 0 THEN 'run' WHEN c_nationkey % 2 = 0 THEN 'installed' END AS place FROM customer""")
def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the code of each plugin lies: what the run folder has goes before what is installed."""
    file = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"), F.lit(".lua")).alias("filename")
    n = read(spark, sf_dir, "nation")
    plugins = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plugin"), file("c_nationkey"))
    return placement.code_places(plugins, n.where("n_nationkey % 3 = 0").select(file("n_nationkey")), n.where("n_nationkey % 2 = 0").select(file("n_nationkey"))).select("plugin", "place")


@query("""WITH e AS (SELECT 'output.' || c_nationkey AS plugin, c_custkey AS ended, c_custkey % 4 = 0 AS reloaded FROM customer), l AS (SELECT plugin, max(ended) FILTER (reloaded) AS reload FROM e GROUP BY plugin)
SELECT plugin, max(ended) AS ended FROM e JOIN l USING (plugin) WHERE NOT reloaded AND (reload IS NULL OR ended > reload) GROUP BY plugin""")
def termination_after_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that stands beside each plugin: its last end, if it wasn't loaded again since."""
    k = F.col("c_custkey")
    e = read(spark, sf_dir, "customer").select(F.concat(F.lit("output."), F.col("c_nationkey").cast("string")).alias("plugin"), k.alias("ended"), (k % 4 == 0).alias("reloaded"))
    last = e.groupBy("plugin").agg(F.max(F.when(F.col("reloaded"), F.col("ended"))).alias("reload"), F.max(F.when(~F.col("reloaded"), F.col("ended"))).alias("ended"))
    return last.where("ended is not null and (reload is null or ended > reload)").select("plugin", "ended")
