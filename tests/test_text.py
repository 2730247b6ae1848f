"""Column expressions against values known by hand."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumbre.functions.text import (
    first_value_after,
    is_blank,
    joined_or,
    json_at,
    pretty_size,
    run_key,
    space_tokens,
    stripped,
)


def values(spark, kind, items, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_size_boundaries(spark):
    known = {
        0: "0 bytes",
        10239: "10239 bytes",
        10240: "10 kB",
        11776: "12 kB",
        10485247: "10239 kB",
        10485248: "10 MB",
        10 * 2**30: "10 GB",
        100 * 2**40: "100 TB",
        20 * 2**50: "20480 TB",
    }
    assert values(spark, "long", list(known), pretty_size) == list(known.values())


def java_split(line: str) -> list[str]:
    """Split on single spaces the way the JVM does: trailing empty strings go, an empty text stays."""
    if line == "":
        return [""]
    parts = line.split(" ")
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def test_space_tokens(spark):
    lines = ["", "   ", " a", "a  b  ", "a b", "\ta b"]
    assert values(spark, "string", lines, space_tokens) == [[""], [], ["", "a"], ["a", "", "b"], ["a", "b"], ["\ta", "b"]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" ab", max_size=8), min_size=1, max_size=40))
def test_space_tokens_like_the_jvm(spark, lines):
    assert values(spark, "string", lines, space_tokens) == [java_split(line) for line in lines]


def test_joined_or(spark):
    assert values(spark, "array<string>", [["a", "b"], [], None], lambda v: joined_or(v, "Ninguna")) == [
        "a, b",
        "Ninguna",
        "Ninguna",
    ]


def test_first_value_after(spark):
    lines = ["Pi is roughly 3.14 ", "roughly a roughly b", "nothing", "roughly"]
    assert values(spark, "string", lines, lambda v: first_value_after(v, "roughly")) == ["3.14", "a", None, ""]


@pytest.mark.parametrize(
    ("name", "expected"),
    [("SparkPi-Example", "sparkpi-example-1704067205"), ("My Daily_Job", "my-daily-job-1704067205")],
)
def test_run_key(spark, name, expected):
    start = dt.datetime(2024, 1, 1, 0, 0, 5, 999999)
    rows = spark.createDataFrame([(name, start)], "name string, start timestamp_ntz")
    assert rows.select(run_key(F.col("name"), F.col("start"))).first()[0] == expected


WHITE_TEXTS = ["", "   ", "\t", "\r", "\xa0", "\u3000\x1f", " a ", "\ta b\r\n", "\xa0x\u2028", "\u200bx", None]


def test_white_space_is_that_of_strip(spark):
    assert values(spark, "string", WHITE_TEXTS, is_blank) == [None if t is None else not t.strip() for t in WHITE_TEXTS]
    assert values(spark, "string", WHITE_TEXTS, stripped) == [None if t is None else t.strip() for t in WHITE_TEXTS]
    assert values(spark, "string", ["Pi is roughly 3.14\r"], lambda c: first_value_after(c, "roughly")) == ["3.14"]


def test_json_at(spark):
    texts = ['{"status": {"applicationState": {"state": "RUNNING"}}}', '{"status": {}}', '{"status": null}', "no json", None]
    path = "status.applicationState.state"
    assert values(spark, "string", texts, lambda c: json_at(c, path, "UNKNOWN")) == ["RUNNING", *["UNKNOWN"] * 4]
