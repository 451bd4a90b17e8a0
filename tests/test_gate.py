import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions import checks
from gristmill.functions.json_text import parse_record
from gristmill.functions.record import VariantRecord
from gristmill.operators.gate import (
    GateConfig,
    accepted_rows,
    gate,
    lenient,
    observe_gate,
    predict,
    quality_report,
    quarantined_rows,
    report_of,
    require_accepted,
    rule_counts,
    shorten_errors,
)
from gristmill.operators.validation import (
    constraint_violations,
    python_validator,
    violations,
    violations_by_rule,
)

GOOD = '{"number":7,"pier":"north","crane":true}'
BAD = '{"number":99,"pier":"upper","crane":true}'


@pytest.fixture
def record():
    return VariantRecord(F.col("fields"))


def test_closed_and_open_gate(records, record, spec):
    rows = records([GOOD, BAD, "not json"])
    closed = gate(rows, record, spec)
    assert [r.n for r in accepted_rows(closed).orderBy("n").collect()] == [0]
    refused = quarantined_rows(closed).orderBy("n").collect()
    assert [r.n for r in refused] == [1, 2]
    assert {"maximum", "enum"} <= {e.rule for e in refused[0].errors}
    assert [e.rule for e in refused[1].errors] == ["object"]
    open_ = gate(rows, record, spec, GateConfig(fail_closed=False))
    got = [(r.is_valid, r.accepted, len(r.errors) > 0) for r in open_.orderBy("n").collect()]
    assert got == [(True, True, False), (False, True, True), (False, True, True)]


def test_disabled_gate_and_error_limit(records, record, spec):
    rows = records([BAD, "[]"])
    off = gate(rows, record, spec, GateConfig(enable_validation=False)).collect()
    assert all(r.accepted and r.is_valid and r.errors == [] for r in off)
    whole = gate(rows, record, spec)
    assert max(len(r.errors) for r in whole.collect()) > 1
    assert all(len(r.errors) == 1 for r in shorten_errors(whole, 1).collect())


def test_strict_gate_fails_the_job(records, record, spec):
    assert require_accepted(gate(records([GOOD]), record, spec)).count() == 1
    with pytest.raises(Exception, match="the gate refused a row"):
        require_accepted(gate(records([GOOD, BAD]), record, spec)).collect()


def test_lenient_gate_returns_every_row(records, record, spec):
    rows = lenient(gate(records([GOOD, BAD]), record, spec)).orderBy("n").collect()
    assert [len(r.errors) > 0 for r in rows] == [False, True]


def test_report_and_metrics(records, record, spec):
    gated = gate(records([GOOD, BAD, BAD, "{}"]), record, spec)
    report = quality_report(gated).first()
    assert (report.rows, report.accepted, report.rejected, report.status) == (4, 1, 3, "unhealthy")
    assert {r.rule: r.rows for r in report.rules}["oneOf"] == 3
    assert quality_report(gated, max_rejected_share=0.75).first().status == "healthy"
    empty = quality_report(gated.where("n < 0")).first()
    assert (empty.rows, empty.status, empty.rules) == (0, "healthy", [])
    # Reports of batches add up to the report of all.
    batches = [rule_counts(gated.where(f"n % 2 = {i}")) for i in (0, 1)]
    assert report_of(batches[0].unionByName(batches[1])).first() == report
    observed, observation = observe_gate(gated, "m")
    assert observed.count() == 4
    assert observation.get == {"rows": 4, "accepted": 1, "rejected": 3}


def test_predict(records, spec):
    def model(prompts):
        numbers = [int(p.split("\n")[0].removeprefix("number: ")) for p in prompts]
        return [
            p if "south" in p else json.dumps({"number": n + 1, "pier": "south", "crane": False})
            for p, n in zip(prompts, numbers, strict=True)
        ]

    rows = records([GOOD, GOOD.replace("north", "south")]).drop("fields")
    got = predict(rows, "raw", spec, model).orderBy("n")
    got = got.select("prompt", F.to_json("output").alias("output"), "output_valid").collect()
    assert got[0].prompt == "number: 7\npier: north\ncrane: true"
    assert json.loads(got[0].output) == {"number": 8, "pier": "south", "crane": False}
    assert json.loads(got[1].output) == {"text": got[1].prompt}
    assert [r.output_valid for r in got] == [True, False]
    with pytest.raises(Exception, match="the gate refused a row"):
        predict(records([BAD]).drop("fields"), "raw", spec, model).collect()
    assert predict(records([BAD]).drop("fields"), "raw", spec, model, strict=False).count() == 0


def test_violation_tables(records, record, spec):
    rows = records([GOOD, BAD, BAD])
    found = checks.entity_errors(record, spec.entity("Berth"))
    assert violations(rows, found, ["n"]).count() == 4
    counts = {(r.rule, r.field): r.n for r in violations_by_rule(rows, found).collect()}
    assert counts == {("range", "number"): 2, ("enum", "pier"): 2}


def test_severity_does_not_change_validity(records, record, spec):
    rows = records(['{"pier":"east","tons":38}'])
    broken = constraint_violations(rows, record, spec.constraints, ["n"]).orderBy("severity").collect()
    assert [(r.severity, r.message) for r in broken] == [
        ("error", "long piers only"),
        ("warning", "needs the big crane"),
    ]


def test_python_validator_failure_is_an_error(records, record, answers):
    batches = []

    def adult(people):
        batches.append(len(people))
        return [person["age"] > 18 for person in people]

    rows = records(['{"age":30}', '{"age":3}', "{}", "x"]).coalesce(1)
    rows = rows.withColumn("verdict", python_validator(adult)(F.col("raw")))
    found = checks.custom_errors({"adult": F.col("verdict.ok")})
    messages = [[e.message for e in errors] for errors in answers(rows, found)]
    assert messages == [
        [], ["the check said no"], ["the check gave no answer"], ["the check gave no answer"],
    ]
    problems = answers(rows, F.col("verdict.problem"))
    assert problems[:2] == [None, None] and problems[2].startswith("KeyError")
    assert problems[3].startswith("JSONDecodeError")


def test_typed_table_gate(spark, spec):
    from gristmill.functions.record import TypedRecord

    df = spark.createDataFrame(
        [(1, 7, "north", True, None), (2, 7, "north", True, "r"), (3, -1, "north", True, "r")],
        "n int, number int, pier string, crane boolean, remark string",
    )
    record = TypedRecord(df, ["number", "pier", "crane", "remark"])
    gated = gate(df, record, spec).orderBy("n").collect()
    # a null cell counts as present, and null is no string
    assert [r.accepted for r in gated] == [False, True, False]


def test_record_in_a_sql_array(records):
    """Records survive a trip through JSON text."""
    rows = records([GOOD])
    raw = F.to_json(F.transform_values("fields", lambda _, v: v["value"]))
    again = rows.select(F.map_keys(parse_record(raw))).first()[0]
    assert again == ["number", "pier", "crane"]
