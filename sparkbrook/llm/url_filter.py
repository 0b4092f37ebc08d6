"""URL filters: host and path rules, and a path-template tree judged by smoothed labelled purity (DataFrame functions only).

Rules. ``host/path``: fits its host and all subdomains if the url's path starts with the rule's; the longest wins.

Method. Urls are first counted by host and path shape (digits as ``{n}``), so that a hot host is a handful of rows before anything
else moves. Shapes form a tree per host, a level a segment: under one parent, more than ``MAX_LITERALS`` different segments become
the wildcard ``*``. Segments beyond ``DEPTH`` become ``**``. Labels: what a rule decides, and of other rows the page's content: blocked
if it holds a word of ``SPAM_WORDS``, else not; pages without content have none. A template's sibling
branches that are statistically similar, that is, whose labelled share of blocked rows lies within ``Z`` standard errors of their parent's, are
merged and judged by their sum; the others stand alone. A template is rejected if its share of blocked rows, smoothed by ``PRIOR``
rows of no tendency, is at least ``PURITY``: without labels nothing is rejected.

Only rejected templates are met with the rows, salted, so a hot template is no hot key.

Defined cases. Null urls and urls without ``://``: empty host and path, no rule fits, allowed. Repeated rows: one row each out. Null ids are
kept, and repeated ones count each. Null or empty pages: no label. Very long urls: one pass, ``DEPTH`` levels. Empty table: empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: (verdict, rule) of the production filter.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEPTH, MAX_LITERALS, Z, PRIOR, PURITY, SALTS = 4, 20, 2.0, 2.0, 0.8, 32
#: Words, in lower case, that stand in pages of sellers and cheats: the labels of content.
SPAM_WORDS = ("adult", "bets", "casino", "jackpot", "lottery", "pills", "porn", "spam", "viagra")
_SPAM = f"(^|[^a-z])({'|'.join(SPAM_WORDS)})([^a-z]|$)"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_index(rules: Sequence[tuple[str, str]], host_: Column, path_: Column) -> Column:
    """Place in ``rules`` of the longest that fits (of equal lengths the first), else null. One expression: rules are few."""
    best = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1]), -i)):
        name, slash, tail = rules[i][1].partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(slash + tail)
        best = F.when(fits, F.lit(i)).otherwise(best)
    return best


def shape(path_: Column) -> Column:
    return F.regexp_replace(path_, "[0-9]+", "{n}")


def templates(counted: DataFrame, depth: int = DEPTH, max_literals: int = MAX_LITERALS) -> DataFrame:
    """``counted`` (host, shape, ...) with ``template``: the path in the host's tree, and ``parent``, the template without its last segment."""
    parts = F.split(F.col("shape"), "/")
    out = written(counted, "url-shapes").withColumn("segments", F.when(F.size(parts) > depth + 1, F.concat(F.slice(parts, 1, depth + 1), F.array(F.lit("**")))).otherwise(parts)).withColumn("template", F.lit("")).withColumn("parent", F.lit(""))
    for level in range(1, depth + 3):  # the first segment is what stands before the leading slash
        segment = F.get("segments", F.lit(level - 1))
        width = out.select("host", "template", segment.alias("s")).where("s is not null").groupBy("host", "template").agg(F.count_distinct("s").alias("width"))
        name = F.when(F.col("width") > max_literals, F.lit("*")).otherwise(segment)
        grown = F.when(segment.isNull(), F.col("template")).otherwise(F.lit("") if level == 1 else F.concat(F.col("template"), F.lit("/"), name))
        if level == 1:
            grown = F.coalesce(segment, F.lit(""))
        # every level is written: each is read twice, and plans would double from level to level
        out = written(out.join(width, ["host", "template"], "left").withColumn("__grown", grown).withColumn("parent", F.when(segment.isNull(), F.col("parent")).otherwise(F.col("template"))).drop("template", "width").withColumnRenamed("__grown", "template"), "url-tree")
    return out.drop("segments")


def rejected(templated: DataFrame, *, z: float = Z, prior: float = PRIOR, purity: float = PURITY) -> DataFrame:
    """(host, shape) of the templates that are rejected; ``templated``: host, shape, template, parent, labelled, blocked."""
    nodes = templated.groupBy("host", "parent", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    pool = nodes.groupBy("host", "parent").agg(F.sum("labelled").alias("pool_labelled"), F.sum("blocked").alias("pool_blocked"))
    share = F.col("pool_blocked") / F.nullif(F.col("pool_labelled"), F.lit(0))
    met = nodes.join(pool, ["host", "parent"]).withColumn(
        "merged", (F.col("labelled") > 0) & F.coalesce(F.abs(F.col("blocked") - F.col("labelled") * share) <= F.lit(z) * F.sqrt(F.col("labelled") * share * (1 - share)), F.lit(False)))
    sums = met.where("merged").groupBy("host", "parent").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    judged = met.join(sums, ["host", "parent"], "left").select(
        "host", "template", F.when(F.col("merged"), F.col("l")).otherwise(F.col("labelled")).alias("l"), F.when(F.col("merged"), F.col("b")).otherwise(F.col("blocked")).alias("b"))
    bad = judged.where((F.col("b") + F.lit(prior / 2)) / (F.col("l") + F.lit(prior)) >= F.lit(purity)).select("host", "template")
    return templated.select("host", "shape", "template").join(bad, ["host", "template"], "left_semi").select("host", "shape").distinct()


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, rules: Sequence[tuple[str, str]] = RULES, **settings) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row."""
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), ascii_lower(F.nullif(F.col(html_col), F.lit(""))).rlike(_SPAM).alias("__spam"))
    rows = rows.withColumn("__at", rule_index(rules, F.col("host"), F.col("path")))
    pick = lambda k: F.get(F.array(*[F.lit(r[k]) for r in rules]), F.col("__at")) if rules else F.lit(None).cast("string")
    rows = rows.withColumns({"rule": pick(1), "__ruled": pick(0), "shape": shape(F.col("path"))}).drop("__at")
    counted = rows.withColumn("__label", F.coalesce(F.col("__ruled") == "block", F.col("__spam"))).groupBy("host", "shape").agg(F.count("__label").alias("labelled"), F.count_if("__label").alias("blocked"))
    tree = {k: settings.pop(k) for k in ("depth", "max_literals") if k in settings}
    bad = rejected(templates(counted, **tree), **settings)
    bad = bad.withColumn("__bad", F.lit(True)).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).join(bad, ["host", "shape", "__salt"], "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("__ruled", F.when(F.col("__bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def _sql() -> str:
    """DuckDB SQL for judge_urls with the production settings; the levels of the tree are as many steps."""
    steps, last = [], "t0"
    for level in range(1, DEPTH + 3):
        now, s = f"t{level}", f"segments[{level}]"
        grown = f"coalesce({s}, '')" if level == 1 else f"CASE WHEN {s} IS NULL THEN template ELSE template || '/' || CASE WHEN width > {MAX_LITERALS} THEN '*' ELSE {s} END END"
        steps.append(f"""w{level} AS (SELECT host, template, count(DISTINCT {s}) AS width FROM {last} WHERE {s} IS NOT NULL GROUP BY ALL),
{now} AS (SELECT host, shape, labelled, blocked, segments, {grown} AS template, CASE WHEN {s} IS NULL THEN parent ELSE template END AS parent FROM {last} LEFT JOIN w{level} USING (host, template))""")
        last = now
    by_length = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda r: (lambda n, _, p: f"(host = '{n}' OR host LIKE '%.{n}') AND path LIKE '/{p}%'")(*r[1].partition("/"))
    pick = lambda k: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[k]}'" for r in by_length) + " END"
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
                  regexp_matches(translate(nullif(html, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPAM}') AS spam FROM pages),
d AS (SELECT *, {pick(1)} AS rule, {pick(0)} AS ruled, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS shape FROM u),
c AS (SELECT host, shape, count(coalesce(ruled = 'block', spam)) AS labelled, count(*) FILTER (coalesce(ruled = 'block', spam)) AS blocked FROM d GROUP BY ALL),
t0 AS (SELECT *, CASE WHEN len(string_split(shape, '/')) > {DEPTH + 1} THEN string_split(shape, '/')[1:{DEPTH + 1}] || ['**'] ELSE string_split(shape, '/') END AS segments, '' AS template, '' AS parent FROM c),
{", ".join(steps)},
n AS (SELECT host, parent, template, sum(labelled) AS labelled, sum(blocked) AS blocked FROM {last} GROUP BY ALL),
p AS (SELECT host, parent, sum(labelled) AS pl, sum(blocked) AS pb FROM n GROUP BY ALL),
m AS (SELECT n.*, labelled > 0 AND abs(blocked - labelled * (pb / pl)) <= {Z} * sqrt(labelled * (pb / pl) * (1 - pb / pl)) AS merged FROM n JOIN p USING (host, parent)),
s AS (SELECT host, parent, sum(labelled) AS l, sum(blocked) AS b FROM m WHERE merged GROUP BY ALL),
j AS (SELECT m.host, m.template, CASE WHEN merged THEN l ELSE labelled END AS l, CASE WHEN merged THEN b ELSE blocked END AS b FROM m LEFT JOIN s USING (host, parent)),
x AS (SELECT DISTINCT host, shape FROM {last} SEMI JOIN (SELECT host, template FROM j WHERE (b + {PRIOR / 2}) / (l + {PRIOR}) >= {PURITY}) USING (host, template))
SELECT page_id, d.host, path, rule, coalesce(ruled, CASE WHEN x.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM d LEFT JOIN x ON d.host = x.host AND d.shape = x.shape
"""


URL_SQL = _sql()
