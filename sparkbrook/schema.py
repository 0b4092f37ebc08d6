"""The message: the one record type of the stream, and the driver's tables seen as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("value_type", T.IntegerType()), T.StructField("representation", T.StringType()),
    T.StructField("v_string", T.StringType()), T.StructField("v_bytes", T.BinaryType()), T.StructField("v_int", T.LongType()),
    T.StructField("v_double", T.DoubleType()), T.StructField("v_bool", T.BooleanType()),
])
#: Header columns, then the open fields; timestamps are nanoseconds and never pass through a timestamp type.
MESSAGE = T.StructType([
    T.StructField("uuid", T.StringType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("logger", T.StringType()), T.StructField("severity", T.IntegerType()), T.StructField("payload", T.StringType()),
    T.StructField("env_version", T.StringType()), T.StructField("pid", T.IntegerType()), T.StructField("hostname", T.StringType()),
    T.StructField("fields", T.ArrayType(FIELD)),
])
STRING, BYTES, INTEGER, DOUBLE, BOOL = range(5)


def field(name: str, value: Column, kind: int = STRING, representation: str | None = None) -> Column:
    """A field; a null value gives a field without value (filter those out with ``present``)."""
    slots = {STRING: "v_string", BYTES: "v_bytes", INTEGER: "v_int", DOUBLE: "v_double", BOOL: "v_bool"}
    typed = {f.name: F.lit(None).cast(f.dataType) for f in FIELD}
    typed |= {"name": F.lit(name), "value_type": F.lit(kind), "representation": F.lit(representation).cast("string"), slots[kind]: value.cast(FIELD[slots[kind]].dataType)}
    return F.struct(*[typed[f.name].alias(f.name) for f in FIELD])


def strings(fields: Column) -> Column:
    """Map of the string fields: the form that predicates read; promote hot fields to columns."""
    return F.map_from_entries(F.transform(F.filter(fields, lambda f: f["value_type"] == STRING), lambda f: F.struct(f["name"], f["v_string"])))


def numbers(fields: Column) -> Column:
    """Map of the numeric fields as doubles."""
    numeric = F.filter(fields, lambda f: f["value_type"].isin(INTEGER, DOUBLE))
    return F.map_from_entries(F.transform(numeric, lambda f: F.struct(f["name"], F.coalesce(f["v_double"], f["v_int"].cast("double")))))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as messages with ``pos``, ``queue`` and the promoted fields ``user_id`` and ``value``."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type").isin("error", "signup"), "analysis").otherwise("input").alias("queue"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("uuid"),
        (micros(F.col("ts")) * 1000).alias("timestamp_ns"),
        F.col("event_type").alias("type"),
        F.lit("input.events").alias("logger"),
        F.when(F.col("event_type") == "error", 3).otherwise(7).alias("severity"),
        F.col("props").alias("payload"),
        F.lit(None).cast("string").alias("env_version"),
        F.lit(1).alias("pid"),
        F.concat(F.lit("host"), (F.col("user_id") % 10).cast("string")).alias("hostname"),
        "user_id", "value",
    )


#: The same in DuckDB SQL.
EVENTS_SQL = """SELECT event_id AS pos, CASE WHEN event_type IN ('error', 'signup') THEN 'analysis' ELSE 'input' END AS queue,
  sha256(event_id::VARCHAR) AS uuid, epoch_us(ts) * 1000 AS timestamp_ns, event_type AS type, 'input.events' AS logger,
  CASE WHEN event_type = 'error' THEN 3 ELSE 7 END AS severity, props AS payload, NULL::VARCHAR AS env_version, 1 AS pid,
  'host' || (user_id % 10) AS hostname, user_id, value FROM events"""
