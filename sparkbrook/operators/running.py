"""Running aggregates along a position without putting the stream in one task.

Positions are cut into blocks of ``BLOCK``; each block is summed up, the blocks' sums run along (a row a block), and rows run along within their
block only, starting from what came before it. One shuffle of the rows, by block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def running(df: DataFrame, value: Column, name: str, *, pos: str = "pos", by: Sequence[str] = (), fold: str = "sum", before: bool = False, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: the sum, max or count of ``value`` up to each row, or (``before``) up to the one before it (sum and count: 0 at the start)."""
    total: Callable[[Column], Column] = {"sum": F.sum, "max": F.max, "count": F.count}[fold]
    join = F.sum if fold in ("sum", "count") else F.max
    keys = [*by, "__block"]
    rows = df.withColumns({"__block": F.floor(F.col(pos) / block), "__value": value})
    sums = rows.groupBy(*keys).agg(total(F.col("__value")).alias("__sum"))
    along = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, join("__sum").over(along).alias("__start"))
    within = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    met = rows.join(starts, keys).withColumn("__in", total(F.col("__value")).over(within))
    if fold == "max":
        out = F.greatest(F.col("__start"), F.col("__in"))
    else:
        out = F.coalesce(F.col("__start"), F.lit(0)) + F.coalesce(F.col("__in"), F.lit(0))
    return met.withColumn(name, out).drop("__block", "__value", "__start", "__in")
