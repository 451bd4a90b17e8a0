import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions import checks
from gristmill.functions.json_text import parse_record
from gristmill.functions.prompt import (
    extract_json,
    extract_json_text,
    format_fields,
    parse_output,
)
from gristmill.functions.record import VariantRecord
from gristmill.operators.candidates import best_of, rejection_log
from gristmill.operators.conformance import (
    check_examples,
    examples_table,
    failures,
    generate,
    generate_broken,
)
from gristmill.operators.schema import as_table, fill_defaults, read_as, route, table_schema
from gristmill.operators.training import SLICE_BYTES, output_conforms, pair_columns, tokenize, training_text
from gristmill.spec import Spec


@pytest.mark.parametrize(
    "text, found",
    [
        ('x {"a":1} y {"b":2}', '{"a":1}'), ('x {"a":{"b":1}} y', '{"b":1}'), ('{bad} {"a":1}', '{"a":1}'),
        ("[1,2]", "[1,2]"), ("plain", None), ('{"a":\n1}', '{"a":\n1}'), ('x {"a":"}"} y', '{"a":"}"}'),
        ("5", "5"), ("", None), ("{}", "{}"), ('{"a":1', None), ('a {bad} b', None), ("{{}", "{}"),
    ],
)
def test_extract_json(spark, text, found):
    row = spark.createDataFrame([(text,)], "t string").select(
        extract_json_text(F.col("t")), F.to_json(extract_json(F.col("t")))
    ).first()
    assert row[0] == found
    assert (None if row[1] is None else json.loads(row[1])) == (None if found is None else json.loads(found))


def test_parse_output(spark):
    rows = spark.createDataFrame([('{"a":1}',), ("plain \"x\"",), ("[1]",), ("",)], "t string")
    got = [json.loads(r[0]) for r in rows.select(F.to_json(parse_output(F.col("t")))).collect()]
    assert got == [{"a": 1}, {"text": 'plain "x"'}, [1], {"text": ""}]


def candidates(spark):
    rows = [
        (1, 1, '{"k":1}'), (1, 2, '{"k":2}'), (2, 1, "no"), (2, 2, '{"k":99}'), (2, 3, '{"k":3}'), (2, 4, '{"k":4}'),
        (3, 1, "a"), (3, 2, "b"), *[(4, i, '{"k":5}' if i == 11 else f"bad {i}") for i in range(1, 13)],
    ]
    df = spark.createDataFrame(rows, "prompt_id long, attempt int, text string").repartition(5)
    return df.withColumn("fields", parse_record(extract_json_text(F.col("text"))))


@pytest.fixture(scope="module")
def small():
    return Spec.from_dict({"entities": {"S": {"fields": {"k": {"type": "int", "range": [0, 9]}}}}})


def test_best_of(spark, small):
    valid = checks.schema_valid(VariantRecord(F.col("fields")), small)
    got = {r.prompt_id: (r.attempt, r.text, r.accepted) for r in best_of(candidates(spark), valid).collect()}
    assert got == {
        1: (1, '{"k":1}', True), 2: (3, '{"k":3}', True), 3: (2, "b", False), 4: (11, '{"k":5}', True),
    }
    fewer = best_of(candidates(spark), valid, max_attempts=10).where("prompt_id = 4").first()
    assert (fewer.attempt, fewer.text, fewer.accepted) == (10, "bad 10", False)


def test_rejection_log(spark, small):
    errors = checks.output_errors(VariantRecord(F.col("fields")), small)
    log = rejection_log(candidates(spark), errors).where("prompt_id = 2").orderBy("attempt", "rule").collect()
    assert [(r.attempt, r.rule) for r in log] == [(1, "object"), (2, "maximum"), (2, "oneOf")]


def python_prompt(value):
    if not isinstance(value, dict):
        return str(value)
    return "\n".join(f"{k}: {v if isinstance(v, str) else json.dumps(v)}" for k, v in value.items())


VALUES = [
    {"b": "x", "a": 1, "c": 1.0, "d": 2.5, "e": None, "f": True}, {}, {"z": {}, "y": []}, {"t": "line\nbreak \"q\""},
    {"n": [1], "o": {"k": 1.0}}, {"big": 10**20, "small": -3}, {"a": False},
]


def test_format_fields(spark):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "n int, raw string")
    got = [r[0] for r in rows.orderBy("n").select(format_fields(F.col("raw"))).collect()]
    assert got == [python_prompt(v) for v in VALUES]


NESTED = [
    {"a": [1, 2, {"b": [], "c": {}}], "s": "[1,2] {\"x\":1}"}, {"é": {"k": "é\u2028\U0001f600", "l": "a\"b\\c, d: e"}},
    {"t": ["\u0001\u001f\u007f\n\t", "/"], "n": [None, True, 1.5, -2]}, {"deep": [[[["x"]]]], "e": [[], {}, [{}]]},
]


def test_nested_values_are_laid_out_as_in_python(spark):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(NESTED)], "n int, raw string")
    got = [r[0] for r in rows.orderBy("n").select(format_fields(F.col("raw"))).collect()]
    assert got == [python_prompt(v) for v in NESTED]
    pairs = [{"input": "x", "output": v} for v in NESTED]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(pairs)], "n int, raw string")
    got = [r.text for r in training_text(rows, "raw", keep=["n"]).orderBy("n").collect()]
    assert got == [python_example(e) for e in pairs]


EXAMPLES = [
    {"input": {"b": 1, "a": "x"}, "output": {"z": 1.0, "a": "é"}}, {"input": "ask", "output": "answer \"q\""},
    {"input": None, "output": None}, {"input": True, "output": [1, {"b": 1, "a": 2}]}, {"input": 2.0, "output": 1},
    {"text": "ready"}, {"text": None}, {"text": 5}, {}, {"input": {"a": 1}, "text": "no output"},
]


def python_example(example):
    if "input" in example and "output" in example:
        return python_prompt(example["input"]) + "\n" + json.dumps(example["output"], indent=2)
    return f"{example.get('text', '')}\n"


def test_training_text(spark):
    rows = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(EXAMPLES)], "n int, raw string")

    def texts(layout):
        return [r.text for r in training_text(rows, "raw", layout=layout, keep=["n"]).orderBy("n").collect()]

    exact = texts("indented")
    assert exact == [python_example(e) for e in EXAMPLES]
    compact = texts("compact")
    assert compact[0] == 'b: 1\na: x\n{"z":1.0,"a":"é"}'
    assert compact[3] == 'True\n[1,{"b":1,"a":2}]'
    with pytest.raises(ValueError):
        texts("wide")


def test_output_conforms(records, spec, answers):
    berth = '{"number":1,"pier":"x","crane":true}'
    rows = records(['{"input":{},"output":%s}' % berth, '{"input":{},"output":{"number":"5"}}', '{"output":[]}', "{}"])
    assert answers(rows, output_conforms(F.col("fields"), spec)) == [True, False, False, False]


def test_tokenize(spark):
    rows = spark.createDataFrame([(1, " a  b\nc "), (2, ""), (3, "x " * 3000)], "n int, t string")
    got = {r.n: r for r in tokenize(rows, "t", keep=["n"]).collect()}
    assert got[1].input_ids == ["a", "b", "c"] and got[1].labels == got[1].input_ids
    assert got[2].input_ids == [] and len(got[3].input_ids) == 3000
    cut = {r.n: r for r in tokenize(rows, "t", keep=["n"], max_tokens=2048).collect()}
    assert len(cut[3].input_ids) == 2048 and cut[1].input_ids == got[1].input_ids
    rows = rows.union(spark.createDataFrame([(4, None)], "n int, t string"))
    codes = tokenize(rows, "t", lambda texts: [[ord(c) for c in t] for t in texts], keep=["n"], max_tokens=3)
    ids = {r.n: r for r in codes.collect()}
    assert ids[1].input_ids == ids[1].labels == [32, 97, 32] and ids[4].input_ids is None
    assert tokenize(rows, "t").columns == ["input_ids", "labels"]


def test_tokenizer_gets_texts_of_bounded_size(spark):
    """Whatever Spark's batches hold, a tokenizer's ids are made for a few texts at a time."""
    lengths = [400_000, 300_000, None, 300_000, 300_000, 2_500_000, 0, None, 1_100_000, 5]
    rows = [(n, None if size is None else "x" * size) for n, size in enumerate(lengths)]
    df = spark.createDataFrame(rows, "n int, t string").coalesce(1)
    sizes = tokenize(df, "t", lambda texts: [[len(t), sum(map(len, texts))] for t in texts], keep=["n"])
    got = {r.n: r.input_ids for r in sizes.collect()}
    assert {n: ids and ids[0] for n, ids in got.items()} == dict(enumerate(lengths))
    assert all(ids is None or ids[1] <= max(ids[0], SLICE_BYTES) for ids in got.values())


def test_pair_columns(spark):
    row = spark.range(1).select(pair_columns({"q": F.lit("Q"), "r": F.lit("R")}, F.lit("{}"))).first()
    assert row[0] == "q: Q\nr: R\n{}"


# --- schema ----------------------------------------------------------------------------


def test_table_schema(spec):
    schema = table_schema(spec.entity("Berth"))
    assert schema.simpleString() == "struct<number:bigint,pier:string,crane:boolean,remark:string>"
    assert [f.nullable for f in schema] == [False, False, False, True]
    assert schema["number"].metadata == {"range": [1.0, 60.0]}
    assert schema["pier"].metadata["enum"] == ["north", "south", "east"]
    lists = Spec.from_dict({"entities": {"E": {"fields": {"a": "list[int]", "b": "list[bool]", "c": "float", "d": "odd"}}}})
    assert table_schema(lists.entities[0]).simpleString() == "struct<a:array<bigint>,b:array<boolean>,c:double,d:string>"


def test_reading_and_defaults(spark):
    entity = Spec.from_dict(
        {"entities": {"E": {"fields": {"a": {"type": "int", "default": 7}, "b": {"type": "string", "required": False}}}}}
    ).entities[0]
    rows = spark.createDataFrame([('{"a":1,"b":"x"}',), ("{}",), ('{"a":"no"}',)], "raw string")
    got = rows.select(read_as(F.col("raw"), entity).alias("e")).select("e.*")
    assert [tuple(r) for r in got.collect()] == [(1, "x"), (None, None), (None, None)]
    assert [tuple(r) for r in fill_defaults(got, entity).collect()] == [(1, "x"), (7, None), (7, None)]
    table = as_table(spark.createDataFrame([("5",), ("x",)], "a string"), entity)
    assert [tuple(r) for r in table.collect()] == [(5, None), (None, None)]


def test_route(records, spec):
    rows = records(['{"type":"Berth"}', '{"type":"Cargo"}', '{"type":["Berth"]}', "{}", "[]"])
    tables = route(rows, VariantRecord(F.col("fields")), spec)
    assert {name: [r.n for r in t.collect()] for name, t in tables.items()} == {"Berth": [0], "Cargo": [1]}


# --- conformance -----------------------------------------------------------------------


def test_generated_rows_validate(spark, spec):
    rows = failures(generate(spark.range(2000), "id", spec), spec).cache()
    assert rows.where("NOT is_valid").count() == 0
    both = [rows.where(F.col("raw").contains(f'"{k}"')).count() for k in ("number", "tons", "remark")]
    assert all(300 < n < 1700 for n in both)
    again = generate(spark.range(2000).repartition(3), "id", spec)
    assert again.exceptAll(rows.select("id", "raw")).count() == 0
    assert generate(spark.range(2000), "id", spec, seed=1).exceptAll(rows.select("id", "raw")).count() == 2000
    rows.unpersist()


def test_broken_rows_do_not(spark, spec):
    for entity in spec.entities:
        judged = failures(generate_broken(spark.range(200), "id", entity), spec)
        left = [r.mutation for r in judged.where("is_valid").select("mutation").distinct().collect()]
        assert left == [], left
        assert judged.where("is_valid IS NULL").count() == 0


def test_declared_examples(spark, spec):
    checked = check_examples(examples_table(spark, spec), spec).first()
    # the declared output carries a type, which no entity has
    assert checked.matched_entity is None and not checked.is_valid
    assert "unknown" in {e.rule for e in checked.errors}
