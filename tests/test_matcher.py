from pyspark.sql import functions as F
import pytest

from sparkbrook.functions.lua_patterns import to_regex
from sparkbrook.functions.matcher import MatcherError, compile_matcher

ROWS = "type string, severity int, payload string, f_str map<string,string>"


def taken(spark, text):
    df = spark.createDataFrame([("a", 1, "x1", {"k": "v"}), ("b", 7, None, {}), (None, None, "a.b", {"k": "w"})], ROWS)
    return [r.n for r in df.selectExpr("*", "monotonically_increasing_id() n").where(compile_matcher(text)).selectExpr("coalesce(type, '-') n").collect()]


@pytest.mark.parametrize(("text", "found"), [
    ("TRUE", ["a", "b", "-"]), ("FALSE", []), ("Type == 'a'", ["a"]), ("Type != 'a'", ["b"]), ("!(Type == 'a')", ["b", "-"]), ("Type == NIL", ["-"]),
    ("Severity > 3 || Fields[k] == 'v'", ["a", "b"]), ("Type == 'a' || Type == 'b' && Severity == 7", ["a", "b"]), ("(Type == 'a' || Type == 'b') && Severity == 7", ["b"]),
    (r"Payload =~ '^%w%d$'", ["a"]), (r"Payload =~ 'a%.b'", ["-"]), ("Payload !~ '%d'", ["-"]), ("Fields[k] != NIL", ["a", "-"]), ("Payload =~ /x[0-9]/", ["a"]),
])
def test_taken(spark, text, found):
    assert taken(spark, text) == found


@pytest.mark.parametrize("text", ["", "Type", "Type ==", "Nope == 1", "(TRUE", "TRUE TRUE", "Type =~ 3", "Type < NIL", "Type == 'a' &&", "#"])
def test_refused(spark, text):
    with pytest.raises(MatcherError):
        compile_matcher(text)


def test_a_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumnRenamed("event_type", "type")
    plan = df.where(compile_matcher("Type == 'error'"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan


@pytest.mark.parametrize(("lua", "java"), [("%d+", "[0-9]+"), ("a-b", "a*?b"), ("^%u%w*$", "^[A-Z][A-Za-z0-9]*\\z"), ("[%w_.]+", "[A-Za-z0-9_.]+"), ("%[x%]", r"\[x\]"), ("%D", "[^0-9]"), ("[^%s]", r"[^ \t-\r]"), ("a|b", r"a\|b")])
def test_lua_patterns(lua, java):
    assert to_regex(lua) == java


@pytest.mark.parametrize("lua", ["%b()", "%f[%w]", "[a", "a%"])
def test_lua_patterns_refused(lua):
    with pytest.raises(ValueError, match="."):
        to_regex(lua)


def test_quantifiers_of_lua(spark):
    """A quantifier counts right after a letter, class or set only; elsewhere it is a letter."""
    cases = [("a-b", "aab", True), ("(a)-", "a-", True), ("(a)-$", "a", False), ("a+?", "a?", True), ("^a+?$", "aa", False), ("*a", "*a", True), ("^*a", "a", False), ("%d+%.?%d*$", "12.5", True), ("[ab]*c", "abc", True), ("^%-?x", "-x", True), ("a$b", "a$b", True), ("x|y", "x|y", True)]
    for pattern, text, expected in cases:
        assert spark.createDataFrame([(text,)], "t string").where(F.col("t").rlike(to_regex(pattern))).count() == int(expected), (pattern, text)
