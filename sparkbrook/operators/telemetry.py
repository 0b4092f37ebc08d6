"""Telemetry of plugins and threads: running statistics, delta counters, utilization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import max_rate, round_percentage

#: Columns of the plugin report and of the utilization report, as their files name them.
PLUGIN_COLUMNS = ("Plugin", "Inject Message Count", "Inject Message Bytes", "Process Message Count", "Process Message Failures", "Current Memory", "Max Memory", "Max Output", "Max Instructions",
                  "Message Matcher Avg (ns)", "Message Matcher SD (ns)", "Process Message Avg (ns)", "Process Message SD (ns)", "Timer Event Avg (ns)", "Timer Event SD (ns)")
UTILIZATION_COLUMNS = ("Plugin", "Messages Processed", "% Utilization", "% Message Matcher", "% Process Message", "% Timer Event")
SAMPLE_SECONDS = 6


def latency_stats(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean and sample deviation (0 below two samples)."""
    return samples.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def sampled(messages: DataFrame, clock: str = "clk", every: int = SAMPLE_SECONDS) -> DataFrame:
    """With ``sample_window``, and ``sampled`` for the one message of a window that is measured: the first."""
    rows = messages.withColumn("sample_window", F.call_function("div", F.col(clock), F.lit(every).cast("long")))
    firsts = rows.groupBy("sample_window").agg(F.min("pos").alias("__first"))
    return rows.join(firsts, "sample_window").withColumn("sampled", F.col("pos") == F.col("__first")).drop("__first")


def deltas(counters: DataFrame, by: list[str], order: str, names: list[str]) -> DataFrame:
    """Growth of cumulative counters since the report before; the first report counts from 0."""
    w = Window.partitionBy(*by).orderBy(order)
    return counters.select(*by, order, *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(f"{c}_delta") for c in names])


def time_totals(reports: DataFrame, by: list[str]) -> DataFrame:
    """Nanoseconds by kind of work: averages times counts, each product cut to whole nanoseconds before it is added. Columns: mm_avg, mm_delta, pm_avg, pm_delta, te_avg, ticker."""
    whole = lambda c: c.cast("long")
    ticks = F.when(F.col("ticker") > 0, F.lit(float(SAMPLE_SECONDS)) / F.nullif(F.col("ticker"), F.lit(0))).otherwise(0.0)
    return reports.groupBy(*by).agg(
        F.sum(whole(F.col("mm_avg") * F.col("mm_delta"))).alias("mm_ns"), F.sum(whole(F.col("pm_avg") * F.col("pm_delta"))).alias("pm_ns"),
        F.sum(whole(F.col("te_avg") * ticks)).alias("te_ns"))


def utilization(processed: Column, total_ns: Column, before: Column, seconds: int = SAMPLE_SECONDS) -> tuple[Column, Column]:
    """(messages a second, per cent of the estimated most, at most 255)."""
    rate = F.call_function("div", processed.cast("long"), F.lit(seconds).cast("long"))
    return rate, F.least(round_percentage(rate, max_rate(total_ns, processed, before)), F.lit(255))


def utilization_report(totals: DataFrame) -> DataFrame:
    """(plugin, messages, utilization, mm, pm, te) in per cent; ``totals``: plugin, messages, input_delta, max_mps, mm_ns, pm_ns, te_ns."""
    all_ns = F.col("mm_ns") + F.col("pm_ns") + F.col("te_ns")
    rate = F.greatest(F.call_function("div", F.col("input_delta"), F.lit(SAMPLE_SECONDS).cast("long")), F.call_function("div", F.col("messages"), F.lit(SAMPLE_SECONDS).cast("long")))
    return totals.select("plugin", "messages", F.least(round_percentage(rate, F.col("max_mps")), F.lit(255)).alias("utilization"),
                         round_percentage(F.col("mm_ns"), all_ns).alias("mm"), round_percentage(F.col("pm_ns"), all_ns).alias("pm"), round_percentage(F.col("te_ns"), all_ns).alias("te"))


def input_rows(plugin: Column, messages: Column) -> list[Column]:
    """Columns of a utilization row of an input, which has no shares: -1."""
    return [plugin.alias("plugin"), messages.alias("messages"), *[F.lit(-1).alias(c) for c in ("utilization", "mm", "pm", "te")]]


def plugin_report(calls: DataFrame) -> DataFrame:
    """The plugin report (PLUGIN_COLUMNS) from calls: plugin, seq, kind (inject, match, process or timer), code, bytes, memory, output, instructions, ns.

    Counts and times of each kind; times in whole nanoseconds, 0 where there is nothing to measure.
    """
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    whole = lambda x: F.coalesce(F.floor(x), F.lit(0)).cast("long")
    times = [f(of(kind, F.col("ns"))) for kind in ("match", "process", "timer") for f in (F.avg, F.stddev_samp)]
    values = [
        F.count(of("inject", F.lit(1))), F.coalesce(F.sum(of("inject", F.col("bytes"))), F.lit(0)), F.count(of("process", F.lit(1))), F.count_if((F.col("kind") == "process") & (F.col("code") < 0)),
        F.max_by("memory", "seq"), F.max("memory"), F.max("output"), F.max("instructions"), *map(whole, times),
    ]
    return calls.groupBy(F.col("plugin").alias(PLUGIN_COLUMNS[0])).agg(*[v.alias(name) for v, name in zip(values, PLUGIN_COLUMNS[1:], strict=True)])
