"""Timer report: pairs of START and END lines of named timers, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import general_number
from .running import running

LINE = r"(\d+) \[debug\] [A-Za-z0-9_.]+ ([A-Z]+_TIMER):(.+)"


def timer_lines(lines: DataFrame, column: str = "value", pos: str = "pos") -> DataFrame:
    """(pos, ns, prefix, name) of the lines that are timer lines."""
    part = lambda k: F.regexp_extract(column, LINE, k)
    return lines.where(F.col(column).rlike(LINE)).select(pos, part(1).cast("long").alias("ns"), part(2).alias("prefix"), part(3).alias("name"))


def pairs(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Completed timers: (name, pos, delta). A START while open and an END while closed are passed over.

    Of a run of equal prefixes only the first counts, which is what a state per name would do; so a timer needs no state, only what came before it. That is carried
    along positions in blocks, so a name that most lines bear isn't one task.
    """
    keys = by or ["name"]
    here = F.struct("pos", "prefix", "ns")
    last = running(lines, here, "__last", by=keys, fold="max", before=True)
    change = last.where(F.col("__last").isNull() | (F.col("__last")["prefix"] != F.col("prefix"))).drop("__last")
    paired = running(change, here, "__from", by=keys, fold="max", before=True)
    return paired.where("prefix = 'END_TIMER' and __from is not null").select(*keys, "pos", (F.col("ns") - F.col("__from")["ns"]).alias("delta"))


def report(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(name, n, min, max, avg, sd) of every timer with a START; sample deviation, 0 for fewer than two, nulls for none."""
    keys = by or ["name"]
    started = lines.where("prefix = 'START_TIMER'").select(*keys).distinct()
    stats = pairs(lines, by).groupBy(*keys).agg(F.count("*").alias("n"), F.min("delta").alias("min"), F.max("delta").alias("max"), F.avg("delta").alias("avg"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("sd"))
    return started.join(stats, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def report_tsv(reported: DataFrame) -> DataFrame:
    """The report as text columns with numbers as %g prints them."""
    return reported.select(F.col("name").alias("Timer"), F.col("n").alias("Count"), *[general_number(F.col(c).cast("double")).alias(c.capitalize() if c != "sd" else "SD") for c in ("min", "max", "avg", "sd")])
