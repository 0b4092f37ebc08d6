"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every source has a target number of words. A document's expected copies are its source's target divided by its source's
size; documents of a source stand in order of their sizes, the expected copies are summed along that order, one random
offset (keyed by seed and source) is added, and a document is emitted once for each integer that the sum crosses. Standing
in order of size, each stretch of similar documents gives its share, so the words taken come near the target (the
difference is about one of the largest documents at most).

Scale. A prefix sum along a source would put a hot source in one task. All documents of a source have the same expected
copies, so the sum at a document is its rank times a constant, and the rank is put together from three bounded windows:
over the distinct sizes of a source, over the salts of one (source, size), and over the rows of one (source, size, salt).
The number of salts is the square root of the table's rows, so a cell that holds a third of them is as many salts as each of these has rows: no window holds a hot group. Text moves at
most once, dealt by (source, size, salt).

Defined cases. Null text: size 0. Null source: a source of its own, last. Sources of size 0: target 0, nothing emitted.
Equal sizes: order by salt and id (null first), then by a hash of the text; repeated rows count as rows of their own. Empty
table: empty result. Extra columns stay; working columns begin with ``__mix_``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

def _salt(id_col: str, text_col: str, salts: int) -> Column:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.xxhash64(text_col).cast("string"))).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(salts))


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources. ``sizes`` (source, source_size) has a row for each source.

    The sources, by code point and null last, weigh ``weights``, repeating; they share ``share`` of all sizes. A target stops
    at ``cap`` times its source's size and the excess is shared again by weight. Solved without rounds: by rising
    cap/weight, a source is capped if the level that fills it and all after it is not below its cap.
    """
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1)
    by_fill = every.orderBy("fill", F.col("source").asc_nulls_last())
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    return (
        sizes.withColumn("w", weight)
        .withColumn("limit", F.lit(cap) * F.col("source_size"))
        .withColumn("fill", F.col("limit") / F.col("w"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(rest))
        .withColumn("open_level", F.max(F.when(F.col("level") < F.col("fill"), F.col("level"))).over(every))
        .select("source", "source_size", F.when(F.col("level") < F.col("fill"), F.col("open_level") * F.col("w")).otherwise(F.col("limit")).alias("target"))
    )


def plan_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, size: Column | None = None,
) -> DataFrame:
    """``docs`` with __mix_size, __mix_source_size, __mix_target and __mix_copies (0 up to ``cap``, rounded up) for each row."""
    salts = 1 + math.isqrt(docs.count())
    rows = docs.withColumns({
        "__mix_size": word_count(F.col(text_col)) if size is None else size,
        "__mix_key": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")),
        "__mix_salt": _salt(id_col, text_col, salts),
    })
    cells = written(rows.groupBy("__mix_key", "__mix_size", "__mix_salt").agg(F.count("*").alias("n")), "mix-cells")
    classes = cells.groupBy("__mix_key", "__mix_size").agg(F.sum("n").alias("n"))
    sums = classes.groupBy("__mix_key").agg(F.sum(F.col("n") * F.col("__mix_size")).alias("source_size"))
    named = sums.withColumn("source", F.when(F.col("__mix_key") != "n", F.expr("substring(__mix_key, 2)")))
    goal = targets(named.select("source", "source_size"), weights, share, cap).withColumn("__mix_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__mix_key")).cast("binary")), 1, 13), 16, 10)
    goal = goal.select("__mix_key", F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"),
                       (digits.cast("double") / F.lit(float(2**52))).alias("__mix_offset"))

    def before(*order: str):
        return Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)

    first = classes.select("__mix_key", "__mix_size", F.coalesce(F.sum("n").over(before("__mix_key", "__mix_size")), F.lit(0)).alias("a"))
    second = cells.select("__mix_key", "__mix_size", "__mix_salt", F.coalesce(F.sum("n").over(before("__mix_key", "__mix_size", "__mix_salt")), F.lit(0)).alias("b"))
    starts = second.join(first, ["__mix_key", "__mix_size"]).join(goal, "__mix_key").withColumn("__mix_start", F.col("a") + F.col("b")).drop("a", "b")
    cell = ["__mix_key", "__mix_size", "__mix_salt"]
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(F.col(id_col).asc_nulls_first(), F.xxhash64(text_col))) + F.col("__mix_start")
    rate = F.when(F.col("__mix_source_size") > 0, F.col("__mix_target") / F.col("__mix_source_size")).otherwise(F.lit(0.0))
    crossed = lambda n: F.floor(n * F.col("__mix_rate") + F.col("__mix_offset"))
    return (
        rows.join(starts, cell)
        .withColumns({"__mix_place": place, "__mix_rate": rate})
        .withColumn("__mix_copies", crossed(F.col("__mix_place")) - crossed(F.col("__mix_place") - 1))
        .drop("__mix_key", "__mix_salt", "__mix_start", "__mix_place", "__mix_rate", "__mix_offset")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed documents: each row as many times as it was emitted, with the columns of ``docs``."""
    planned = plan_copies(docs, id_col, text_col, source_col, **settings).where("__mix_copies > 0")
    return planned.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies.

    Sizes are counted once and written; text isn't shuffled.
    """
    slim = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("text")), "mix-sizes")
    plan = plan_copies(slim, size=F.col("words"), **settings)
    return plan.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"),
                       (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"), F.col("__mix_copies").alias("copies"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce('s' || source, 'n') AS k, source,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % (1 + floor(sqrt((SELECT count(*) FROM documents)))::BIGINT) AS salt
  FROM documents),
s AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
             2.0::DOUBLE * source_size AS lim, 1.5::DOUBLE * (SELECT sum(size)::BIGINT FROM d) AS total FROM s),
f AS (SELECT *, lim / w AS fill FROM w),
l AS (SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
               / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT k, source_size, CASE WHEN level < fill THEN (SELECT max(level) FROM l WHERE level < fill) * w ELSE lim END AS target,
             ('0x' || substr(md5('17:' || k), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM l),
r AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
             row_number() OVER (PARTITION BY d.k ORDER BY size, salt, doc_id) AS n FROM d JOIN t USING (k)),
c AS (SELECT *, (floor(n * rate + u) - floor((n - 1) * rate + u))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
