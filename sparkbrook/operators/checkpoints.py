"""The checkpoint table (key, value): lookup with fallbacks, cleanup, and restarts by code file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import escape_string, exact_number, parse_checkpoint_key, parse_position


def lookup(readers: DataFrame, checkpoints: DataFrame, firsts: DataFrame, writers: DataFrame) -> DataFrame:
    """(reader, queue, id, offset, origin): from its own key; else, reading from files, the first file; else the writer's position.

    readers: reader, queue, from_files; checkpoints: key, value; firsts: queue, first_id; writers: queue, writer_id, writer_offset.
    """
    keyed = readers.withColumn("key", F.concat("queue", F.lit("->"), "reader"))
    met = keyed.join(checkpoints, "key", "left").join(firsts, "queue", "left").join(writers, "queue", "left").withColumn("p", parse_position(F.col("value")))
    own, early = F.col("p")["id"].isNotNull(), F.col("from_files") & F.col("first_id").isNotNull()
    pick = lambda a, b, c: F.when(own, a).when(early, b).otherwise(c)
    return met.select("reader", "queue", pick(F.col("p")["id"], F.col("first_id"), F.col("writer_id")).alias("id"),
                      pick(F.col("p")["offset"], F.lit(0).cast("long"), F.col("writer_offset")).alias("offset"), pick(F.lit("checkpoint"), F.lit("first file"), F.lit("writer")).alias("origin"))


def cleanup(checkpoints: DataFrame, plugins: DataFrame, threads: int) -> DataFrame:
    """Checkpoints whose reader can still exist: queues, configured plugins (``plugins``: name), analysis threads below ``threads``."""
    k = parse_checkpoint_key(F.col("key"))
    rows = checkpoints.withColumns({"__kind": k["kind"], "__name": k["name"]})
    queues = rows.where("__kind is null")
    analysis = rows.where((F.col("__kind") == "analysis") & (F.col("__name").cast("int") < threads))
    known = plugins.select(F.col("name").alias("__plugin"))
    others = rows.where("__kind in ('input', 'output')").withColumn("__plugin", F.concat_ws(".", "__kind", "__name")).join(known, "__plugin", "left_semi").drop("__plugin")
    return queues.unionByName(analysis).unionByName(others).select(*checkpoints.columns)


def using_code(plugins: DataFrame, changed: DataFrame) -> DataFrame:
    """Plugins to restart: those whose code file is among ``changed`` (filename)."""
    return plugins.join(changed.select("filename").distinct(), "filename", "left_semi")


def text_line() -> Column:
    """A line of the checkpoint file: a string quoted and escaped, a number with the digits that give it back. Of the columns key, value, number."""
    value = F.coalesce(exact_number(F.col("number")), F.concat(F.lit('"'), escape_string(F.col("value")), F.lit('"')))
    return F.concat(F.lit('_G["'), escape_string(F.col("key")), F.lit('"] = '), value)


def text_lines(checkpoints: DataFrame) -> DataFrame:
    """Lines of the checkpoint file. checkpoints: key, value, number."""
    return checkpoints.select(text_line().alias("value"))
