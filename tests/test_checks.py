import itertools

import pytest
from pyspark.sql import functions as F

from gristmill import Spec
from gristmill.functions import checks
from gristmill.functions.json_text import parse_record
from gristmill.functions.record import TypedRecord, VariantRecord
from gristmill.spec import Constraint, SpecError

BERTH = '{"number":7,"pier":"north","crane":true}'
CARGO = '{"tons":2.5,"kind":"ore","sealed":false}'

# text, exactly one entity, light match, matched entity, constraints
GOLDEN = [
    (BERTH, True, True, "Berth", True),
    (CARGO, True, True, "Cargo", True),
    ('{"number":true,"pier":"north","crane":true}', False, True, "Berth", True),
    ('{"number":7.0,"pier":"north","crane":true}', True, False, None, True),
    ('{"number":7.5,"pier":"north","crane":true}', False, False, None, True),
    ('{"number":99,"pier":"north","crane":true}', False, True, None, True),
    ('{"number":7,"pier":"upper","crane":true}', False, True, None, True),
    ('{"number":7,"pier":"north"}', False, False, None, True),
    ('{"number":7,"pier":"north","crane":true,"x":1}', False, True, None, True),
    ('{"type":"Berth","number":7,"pier":"north","crane":true}', False, True, None, True),
    ('{"number":7,"pier":"east","crane":true}', True, True, "Berth", False),
    ('{"tons":36,"kind":"ore","sealed":false}', True, True, "Cargo", False),
    ('{"number":7,"pier":null,"crane":true}', False, False, None, True),
    ("{}", False, False, None, True),
]


@pytest.fixture
def golden(records):
    return records([g[0] for g in GOLDEN])


@pytest.fixture
def record():
    return VariantRecord(F.col("fields"))


def test_exactly_one_entity(golden, record, spec, answers):
    assert answers(golden, checks.schema_valid(record, spec)) == [g[1] for g in GOLDEN]
    no_error = F.size(checks.schema_errors(record, spec)) == 0
    assert answers(golden, no_error) == [g[1] for g in GOLDEN]


def test_light_match(golden, record, spec, answers):
    assert answers(golden, checks.light_valid(record, spec)) == [g[2] for g in GOLDEN]


def test_matched_entity(golden, record, spec, answers):
    assert answers(golden, checks.matched_entity(record, spec)) == [g[3] for g in GOLDEN]


def test_constraints(golden, record, spec, answers):
    assert answers(golden, checks.constraints_hold(record, spec.constraints)) == [g[4] for g in GOLDEN]
    failed = F.size(checks.constraint_errors(record, spec.constraints)) == 0
    assert answers(golden, failed) == [g[4] for g in GOLDEN]


def test_clean_agrees_with_errors(golden, record, spec, answers):
    for entity in spec.entities:
        quick = answers(golden, checks.entity_clean(record, entity))
        slow = answers(golden, F.size(checks.entity_errors(record, entity)) == 0)
        assert quick == slow


def test_errors_of_entities_tried_before_the_match_are_kept(golden, record, spec, answers):
    found = answers(golden, checks.ontology_errors(record, spec))
    assert found[0] == []
    assert {e.entity for e in found[1]} == {"Berth"}
    assert found[13][-1].rule == "no_entity"
    assert [e.rule for e in found[10]] == ["constraint"]
    # the comparison is not part of record validation
    assert {e.rule for e in found[11]} == {"required", "unknown"}
    valid = answers(golden, checks.ontology_valid(record, spec))
    assert valid == [g[3] is not None and n != 10 for n, g in enumerate(GOLDEN)]


def test_error_rules(golden, record, spec, answers):
    berth = spec.entity("Berth")
    rules = [[e.rule for e in found] for found in answers(golden, checks.entity_errors(record, berth))]
    assert rules[5] == ["range"]
    assert rules[6] == ["enum"]
    assert rules[7] == ["required"]
    assert rules[8] == ["unknown"]
    assert rules[12] == ["type", "enum"]
    assert sorted(rules[13]) == ["required"] * 3


def test_range_on_text_is_an_error_entry(records, record, answers):
    spec = Spec.from_dict({"entities": {"E": {"fields": {"a": {"type": "string", "range": [0, 1]}}}}})
    rows = records(['{"a":"x"}', '{"a":5}', '{"a":null}', '{"a":[0]}'])
    rules = answers(rows, F.transform(checks.entity_errors(record, spec.entities[0]), lambda e: e.rule))
    assert rules == [["range_type"], ["type", "range"], ["type", "range_type"], ["type", "range_type"]]


def test_text_that_is_no_record_is_invalid_not_null(spark, spec, answers):
    texts = ["not json", "[]", '""', "null", "", None, "5", "[1]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, raw string")
    rows = rows.withColumn("fields", parse_record(F.col("raw")))
    record = VariantRecord(F.col("fields"))
    for verdict in (checks.schema_valid, checks.light_valid, checks.ontology_valid):
        assert answers(rows, verdict(record, spec)) == [False] * len(texts)
    assert answers(rows, checks.envelope_valid(F.col("fields"), spec)) == [False] * len(texts)
    sizes = answers(rows, F.size(checks.schema_errors(record, spec)))
    assert all(n > 0 for n in sizes)


def test_envelope(records, spec, answers):
    rows = records(
        [
            '{"type":"Berth","data":%s}' % BERTH,
            '{"type":"Cargo","data":%s}' % BERTH,
            '{"type":"Crew","data":%s}' % BERTH,
            '{"type":"Berth"}',
            '{"type":"Berth","data":[]}',
            '{"type":"Berth","data":{"number":7}}',
            '{"data":%s}' % BERTH,
            '{"type":"Berth","data":%s,"more":1}' % CARGO,
        ]
    )
    got = answers(rows, checks.envelope_valid(F.col("fields"), spec))
    assert got == [True, True, False, False, False, False, False, True]


def test_list_items(records, record, answers):
    kinds = ["string", "int", "float", "bool"]
    spec = Spec.from_dict(
        {"entities": {"E": {"fields": {k: {"type": f"list[{k}]", "required": False} for k in kinds}}}}
    )
    cases = [
        ('{"string":["a","b"]}', True), ('{"string":["a",1]}', False), ('{"string":[]}', True),
        ('{"string":"a"}', False), ('{"int":[1,2.0]}', True), ('{"int":[1,2.5]}', False),
        ('{"int":[true]}', False), ('{"float":[1,2.5]}', True), ('{"float":[null]}', False),
        ('{"bool":[true,false]}', True), ('{"bool":[1]}', False), ('{"int":null}', False), ("{}", True),
    ]
    rows = records([c[0] for c in cases])
    assert answers(rows, checks.schema_valid(record, spec)) == [c[1] for c in cases]
    # record validation and the light check look at list items not at all
    unchecked = answers(rows, checks.entity_clean(record, spec.entities[0]))
    assert unchecked == [True] * len(cases)


def python_compare(value, present, op, rhs):
    """The constraint language, spelled out for one value."""
    import operator

    ops = {"<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt,
           "==": operator.eq, "!=": operator.ne}
    if not present or op not in ops:
        return True
    try:
        if isinstance(value, (int, float)):
            rhs = float(rhs)
        elif isinstance(value, str):
            rhs = rhs.strip("'\"")
        return ops[op](value, rhs)
    except (TypeError, ValueError):
        return True


def test_comparisons_follow_python(records, record, answers):
    import json

    values = [1, 5, 5.0, 5.5, -3, True, False, "5", "active", "b", "", None, [1], {"k": 1}]
    texts = [json.dumps({"f": v}) for v in values] + ["{}"]
    rows = records(texts).cache()
    for op, rhs in itertools.product(
        ["<=", ">=", "<", ">", "==", "!=", "=<"], ["5", "abc", "'active'", "1", '"b" ', "nan"]
    ):
        constraint = Constraint(f"f {op} {rhs}")
        got = answers(rows, checks.constraint_holds(record, constraint))
        if "=<" in op:
            continue  # no such operator: dispatched on the "<" inside it, then ignored
        wanted = [python_compare(v, True, op, rhs) for v in values] + [True]
        assert got == wanted, constraint.expr
    rows.unpersist()


def test_length_rules(records, record, answers):
    rows = records(['{"f":"abc"}', '{"f":"éé"}', '{"f":""}', '{"f":5}', '{"f":null}', "{}"])
    expected = {
        "len(f) <= 2": [False, True, True, True, True, True],
        "len(f) >= 2": [True, True, False, True, True, True],
        "len(f) < 2": [False, False, True, True, True, True],
        "len(f) > 2": [True, False, False, True, True, True],
        "len(f) == 2": [True] * 6,
        "len( f ) <= 0": [True] * 6,
        "f in ['abc']": [True] * 6,
        "f = 5": [True] * 6,
    }
    for expr, wanted in expected.items():
        assert answers(rows, checks.constraint_holds(record, Constraint(expr))) == wanted, expr


def test_constraint_texts():
    """One reading of a text serves every validator."""
    from gristmill.spec import CompareRule, LengthRule, comparisons

    assert comparisons("len(name) <= 5 and age>= 3 ") == [
        LengthRule("name", "<=", "5 and age"), CompareRule("age", ">=", "3 "),
    ]
    assert comparisons("status in ['a']") == comparisons("") == comparisons("<= 5") == comparisons("f >=") == []
    both = Constraint("len(name) > 1, len(name) <= 7 letters")
    assert both.rule == LengthRule("name", ">", "1")
    assert both.simple_length == LengthRule("name", "<=", "7 letters")
    assert Constraint("len(name) is fine, age < 3").rule is None
    assert Constraint("age == 3").simple_length is None


def test_simple_length_reading(records, record, answers):
    rows = records(['{"f":"abc"}', '{"f":5}', "{}"])

    def rules(expr):
        found = answers(rows, checks.simple_constraint_errors(record, Constraint(expr)))
        return [[e.rule for e in errors] for errors in found]

    assert rules("len(f) <= 2") == [["constraint"], [], []]
    assert rules("len(f) < 2") == [[], [], []]
    assert rules("len(f) <= two") == [["constraint_error"], [], []]
    assert rules("f > 9") == [[], [], []]


def test_output_checks_and_switches(records, record, spec, answers):
    bad = '{"type":"Berth","number":99,"pier":"upper","crane":true}'
    rows = records([BERTH, '{"type":"Berth","number":7}', bad, "[]"])

    def rules(**switches):
        return [
            sorted({e.rule for e in errors})
            for errors in answers(rows, checks.output_errors(record, spec, **switches))
        ]

    assert rules(schema=False) == [[], ["required"], ["enum", "maximum"], ["object"]]
    assert rules(schema=False, grammar=False) == [[], [], [], []]
    assert rules(grammar=False)[0] == [] and all(rules(grammar=False)[1:])
    custom = {"high": record.value("number").number > 40}
    assert rules(schema=False, grammar=False, custom=custom) == [["custom"], ["custom"], [], ["custom"]]


def test_field_lengths(records, record, answers):
    spec = Spec.from_dict(
        {"entities": {"E": {"fields": {"a": {"type": "string", "minLength": 2, "maxLength": 3}}}}}
    )
    rows = records(['{"a":"x"}', '{"a":"xy"}', '{"a":"wxyz"}', '{"a":1}'])
    found = answers(rows, checks.field_constraint_errors(record, spec.entities[0]))
    assert [[e.rule for e in f] for f in found] == [["minLength"], [], ["maxLength"], []]


def test_typed_columns_agree_with_open_keys(spark, spec, answers):
    schema = "n int, number bigint, pier string, crane boolean, remark string"
    data = [
        (0, 7, "north", True, "r"), (1, 99, "north", True, "r"), (2, 7, "upper", False, "r"),
        (3, None, "north", True, "r"), (4, -1, None, True, "r"), (5, 1, "east", False, None),
    ]
    df = spark.createDataFrame(data, schema)
    names = ["number", "pier", "crane", "remark"]
    typed = TypedRecord(df, names)
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    open_keys = df.withColumn("fields", parse_record(text))
    record = VariantRecord(F.col("fields"))
    for check in (
        checks.schema_valid, checks.light_valid, checks.matched_entity, checks.ontology_errors,
        checks.ontology_valid, checks.schema_errors,
    ):
        assert answers(df, check(typed, spec)) == answers(open_keys, check(record, spec)), check


def test_nan_is_in_every_range(spark, answers):
    spec = Spec.from_dict({"entities": {"E": {"fields": {"x": {"type": "float", "range": [0, 1]}}}}})
    df = spark.createDataFrame([(0, float("nan")), (1, 0.5), (2, 2.0), (3, float("inf"))], "n int, x double")
    record = TypedRecord(df, ["x"])
    assert answers(df, checks.entity_clean(record, spec.entities[0])) == [True, True, False, False]
    assert answers(df, checks.constraint_holds(record, Constraint("x < 1"))) == [False, True, False, False]
    assert answers(df, checks.constraint_holds(record, Constraint("x != 1"))) == [True] * 4


@pytest.mark.parametrize(
    "body",
    [
        {"entities": {"E": {"fields": {"a": {}}}}},
        {"entities": {"E": {"fields": {"a": {"type": "string", "enum": []}}}}},
        {"entities": {"E": {"fields": {"a": {"type": "string", "enum": "x"}}}}},
        {"entities": {"E": {"fields": {"a": {"type": "int", "range": [1]}}}}},
        {"entities": {"E": {"fields": {"a": {"type": "int", "range": [2, 1]}}}}},
        {"constraints": [{"expr": " "}]},
        {"constraints": [{"expr": "a > 1", "severity": "loud"}]},
        {"examples": [{"input": {}}]},
    ],
)
def test_malformed_specs_are_rejected(body):
    with pytest.raises(SpecError):
        Spec.from_dict(body)


def test_short_field_form():
    spec = Spec.from_dict({"entities": {"E": {"fields": {"a": "string", "b": "weird"}}}})
    a, b = spec.entity("E").fields
    assert (a.type, a.required, b.json_type) == ("string", True, "string")
