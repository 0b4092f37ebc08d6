"""What the corpus operators share: reading tables and cutting lineage in a folder all executors see."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of words in every operator of this package.
WORD = r"[^\x20\x09-\x0D]+"
_places: dict[int, tuple] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What workers remember for an operator (encoders and the ids of chunks): each is emptied when a worker goes on with another step.
remembered: list[dict] = []


def forget() -> None:
    """Give back what a reused worker still remembers for other operators; they build it again when they are called."""
    if any(remembered):
        for x in remembered:
            x.clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # where the C library has it, freed memory goes back to the system
            ctypes.CDLL(None).malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of ``sf_dir``, through Spark's own reader: the folder may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset on one machine (tests), a temporary one, made once a session. On a cluster it must be set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = spark.conf.get("spark.sparkbrook.scratch", None)
    if not own:
        own = f"file://{tempfile.mkdtemp(prefix='sparkbrook-')}"
        spark.conf.set("spark.sparkbrook.scratch", own)
    return own


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs only rereading."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[id(out)] = (weakref.ref(out), path)
    return out


def removed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, once all that was made of them is written itself."""
    for table in tables:
        known, path = _places.pop(id(table), (lambda: None, ""))
        if known() is table:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """What is written meanwhile passes texts to Python by so many rows at once: a batch of Spark's 10,000 is held several times over, by the JVM and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def broadcast_if_small(table: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most ``rows`` rows (counted), else as it is: then Spark joins by a shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def whole_number(df: DataFrame, name: str) -> Column:
    """The ids of an operator that orders by them, as long; a column of another kind is refused rather than cast to nulls."""
    kind = df.schema[name].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name} holds {kind}, not whole numbers")
    return F.col(name).cast("long")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: names that clash or hold dots do no harm until ``toDF`` gives them back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), on the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; no other letter changes."""
    return F.translate(text, UPPER, LOWER)
