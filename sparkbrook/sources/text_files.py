"""Line sources: log files with byte offsets, the daemon's own log, and files of multi-line records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import running
from ..operators.timers import timer_lines


def lines_with_offsets(spark: SparkSession, path: str, *, delimiter: str = "\n", keep_empty: bool = False) -> DataFrame:
    """(path, pos, offset, value): records that end with ``delimiter`` (any letters, taken as they are), with their number in the file and the byte at which each begins.

    Files are split among tasks as Spark splits text, and no task holds a file. Each record is placed by the part of the file it lies in and its order there: parts are
    Spark's own splits, their bytes are summed up by file, and a record starts after the parts before its own and the records before it in its part. Empty records are left out, if not ``keep_empty``. A last
    record may lack its delimiter, and ``\r`` belongs to the record.
    """
    width = len(delimiter.encode())
    text = spark.read.option("lineSep", delimiter).text(path)
    cut = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), "value", F.monotonically_increasing_id().alias("pos"))
    sized = cut.withColumn("bytes", F.octet_length("value").cast("long") + width)
    before = lambda x, *keys: F.coalesce(F.sum(x).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sized.groupBy("path", "part").agg(F.sum("bytes").alias("n"), F.count("*").alias("k"))
    starts = sums.select("path", "part", before("n", "path", "part").alias("start"), before("k", "path", "part").alias("first"))
    placed = sized.select("*", before("bytes", "path", "part", "pos").alias("before"), before(F.lit(1), "path", "part", "pos").alias("number")).join(starts, ["path", "part"])
    return placed.where(F.lit(keep_empty) | (F.col("value") != "")).select("path", (F.col("first") + F.col("number")).alias("pos"), (F.col("start") + F.col("before")).alias("offset"), "value")


def timer_log(spark: SparkSession, path: str) -> DataFrame:
    """Timer lines of the daemon's log (pos, ns, prefix, name)."""
    return timer_lines(lines_with_offsets(spark, path).select("pos", "value"))


def multiline(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(path, offset, record) of files whose records begin with a line that matches ``delimiter`` (a regular expression).

    Lines come from splits of the files. A record's number is the count of beginnings up to a line, by running sums along the offsets; its lines are then joined. What stands
    before the first beginning is dropped. A record is held by one task, a file isn't.
    """
    lines = lines_with_offsets(spark, path, keep_empty=True).withColumn("__begins", F.col("value").rlike(delimiter).cast("long"))
    counted = running(lines, F.col("__begins"), "__record", pos="offset", by=["path"], block=1 << 24)
    joined = counted.where("__record > 0").groupBy("path", "__record").agg(F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("lines"))
    return joined.select("path", "offset", F.array_join(F.col("lines.value"), "\n").alias("record"))
