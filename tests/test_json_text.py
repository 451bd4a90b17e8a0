import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions.json_text import parse_record, parse_value, python_text

TEXTS = [
    '{"a":1}', ' {"a":1}\n', '{"a":1} x', '{"a":1}] x', '{"a":1}} x', '{"a":1}{"b":2}',
    '{"a":1},{"b":2}', '{"a":[1]}', '{"a":[]} ]', "{'a':1}", '{"a":01}', '{"a":+1}', '{"a":.5}',
    '{"a":1.}', '{"a":1,}', '{a:1}', '{"a":"x\ty"}', '{}', "[]", "[1,2]", '""', "5", "true", "null",
    "", "  ", "not json", '{"a":1,"b":[2],"a":3}', '{"a":{"b":1,"b":2}}', "1,null", "[1]]",
    '{"a":"gristmill:end"}', '{"a":1},{"gristmill:end":0}] x', '1,"gristmill:end"] x', '{"gristmill:end":0}',
    '{"a":1},{"gristmill:end":0}', '{"a":1},', ',{"a":1}', '{"a":"]"}', '{"a":"é\\u00e9"}', "1] x", '"]"',
    '{"k":1},{"gristmill\\u003aend":0}', '1,"gristmill\\u003aend"', '1,"gristmill\\u003Aend"] x',
    '{"k":1},{"\\u0067ristmill:end":0}] x', '{"a":"gristmill\\u003aend"}', '"gristmill\\u003aend"',
]

PIECES = ["gristmill:end", "gristmill\\u003aend", '"', "{", "}", "[", "]", ":", ",", "1", " x", "\\u0067ristmill:end",
          '{"a":1}', '"gristmill:end":0']


def python_value(text):
    try:
        return json.loads(text)
    except ValueError:
        return "unreadable"


@pytest.mark.parametrize("parser", [parse_value, parse_record])
def test_reads_what_python_reads(spark, parser):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    value = parser(F.col("t"))
    if parser is parse_record:
        value = F.transform_values(value, lambda _, v: v["value"])
    for text, got in rows.select("t", F.to_json(value)).collect():
        wanted = python_value(text)
        if parser is parse_record and not isinstance(wanted, dict):
            wanted = "unreadable"
        assert (json.loads(got) if got is not None else "unreadable") == wanted, text


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=9).map("".join), min_size=40, max_size=120))
def test_no_text_talks_its_way_past_the_mark(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    read = rows.select("t", parse_value(F.col("t")).isNotNull(), parse_record(F.col("t")).isNotNull())
    for text, value, record in read.collect():
        wanted = python_value(text)
        assert value == (wanted != "unreadable"), text
        assert record == isinstance(wanted, dict), text


def test_key_order_and_absent_versus_null(records):
    row = records(['{"b":null,"a":1,"b":2}', '{"b":null}', "{}"]).orderBy("n")
    got = row.select(F.map_keys("fields"), F.map_contains_key("fields", F.lit("b"))).collect()
    assert [tuple(r) for r in got] == [(["b", "a"], True), (["b"], True), ([], False)]


def test_scalars_print_as_in_python(spark):
    texts = ["1", "1.0", "2.5", "true", "null", '"x"', "12345678901234567890", "0.0"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(python_text(parse_value(F.col("t")))).collect()]
    assert got == [str(json.loads(t)) for t in texts]
