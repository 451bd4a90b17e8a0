import time

import pytest
from pyspark.sql import functions as F

from gristmill.catalog.quality import PHRASES
from gristmill.functions.text import matches
from gristmill.operators.patterns import with_patterns_found

PATTERNS = [
    "abc", "bcd", "c", "abc", r"a.c", r"x[0-9]+y", r"(?i)LOUD", r"^start", r"\bword\b", r"a\.b", "[0-9]{3}", r"naïve|plain", "é", "q(u)?",
]
TEXTS = [
    "abcd", "", None, "x12y and x3y", "so loud", "start\nstart", "no start", "sword", "a word.", "a.b", "axb", "12 345",
    "naïve plain é", "𝒳 q " * 3, "abc" * 50_000,
]


def one_by_one(df, patterns):
    found = F.array_compact(F.array(*[F.when(matches(F.col("text"), p), F.lit(i)) for i, p in enumerate(patterns)]))
    return df.withColumn("found", found)


def test_equal_to_each_pattern_alone(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string")
    got = {r["n"]: r["found"] for r in with_patterns_found(df, F.col("text"), PATTERNS).collect()}
    assert got == {r["n"]: r["found"] for r in one_by_one(df, PATTERNS).collect()}
    # Overlapping literals and a repeated pattern are all told.
    assert got[0] == [0, 1, 2, 3, 4] and got[2] == []


@pytest.mark.parametrize("patterns", [[], ["[a-z]"], ["abc"]])
def test_few_patterns_and_empty_tables(spark, patterns):
    df = spark.createDataFrame([("abc",), (None,)], "text string")
    rows = with_patterns_found(df, F.col("text"), patterns, "hits").collect()
    assert [r["hits"] for r in rows] == [[0] if patterns else [], []]
    assert with_patterns_found(df.limit(0), F.col("text"), patterns).collect() == []


def test_a_pattern_java_cannot_read_is_refused_at_once(spark):
    df = spark.createDataFrame([("abc",)], "text string")
    with pytest.raises(ValueError):
        with_patterns_found(df, F.col("text"), ["ok", r"(?P<name>x)y"])


def test_hundreds_cost_little_more_than_one(spark, documents):
    """500 patterns against five times the time of one, on the same rows."""
    rows = documents.unionAll(documents).unionAll(documents).repartition(8).cache()
    rows.count()

    def seconds(patterns):
        best = []
        for _ in range(3):
            began = time.monotonic()
            with_patterns_found(rows, F.col("text"), patterns).write.format("noop").mode("overwrite").save()
            best.append(time.monotonic() - began)
        return min(best)

    one, many = seconds(PHRASES[:1]), seconds(PHRASES)
    rows.unpersist()
    assert many < 5 * one
