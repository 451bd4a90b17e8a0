"""The gate, its reports, broken records and example pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill import Spec
from gristmill.catalog.outputs import PAIRS, pairs
from gristmill.catalog.registry import query, table
from gristmill.catalog.validation import (
    BAD_PRICE,
    BAD_PRIORITY,
    BAD_STATUS,
    EVENTS,
    ORDER_ERRORS,
    event_spec,
    events,
    fields,
    orders,
)
from gristmill.functions import checks
from gristmill.functions.record import TypedRecord
from gristmill.operators.conformance import check_examples
from gristmill.operators.gate import (
    GateConfig,
    accepted_rows,
    gate,
    lenient,
    observe_gate,
    quality_report,
    quarantined_rows,
    report_of,
    require_accepted,
    rule_counts,
    shorten_errors,
)
from gristmill.operators.records import with_record
from gristmill.session import scratch_path

VALID_EVENT = "event_type <> 'error' AND ((NOT typed AND k <= 60)::INT + (k >= 40)::INT) = 1"


def gated_orders(spark, sf_dir, **config):
    df, record, spec = orders(spark, sf_dir)
    return gate(df, record, spec, GateConfig(**config))


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {ORDER_ERRORS} = 0")
def gate_accepted(spark, sf_dir):
    return accepted_rows(gated_orders(spark, sf_dir)).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT o_orderkey, least({ORDER_ERRORS} + 1, 2) AS n_errors FROM orders WHERE {ORDER_ERRORS} > 0")
def gate_quarantine(spark, sf_dir):
    """Each refused row has its errors, and one saying that no entity matched, cut at two."""
    refused = shorten_errors(quarantined_rows(gated_orders(spark, sf_dir)), 2)
    return refused.select("o_orderkey", F.size("errors").alias("n_errors"))


@query(f"SELECT o_orderkey, {ORDER_ERRORS} = 0 AS is_valid, true AS accepted FROM orders")
def g1_open_gate(spark, sf_dir):
    gated = gated_orders(spark, sf_dir, fail_closed=False)
    return gated.select("o_orderkey", "is_valid", "accepted")


@query("SELECT count(*) AS rows, count(*) AS accepted, 0 AS errors FROM orders")
def g1_disabled_gate(spark, sf_dir):
    gated = gated_orders(spark, sf_dir, enable_validation=False)
    return gated.agg(
        F.count("*").alias("rows"), F.count_if("accepted").alias("accepted"),
        F.sum(F.size("errors")).alias("errors"),
    )


@query(f"SELECT o_orderkey FROM orders WHERE NOT ({BAD_STATUS} OR {BAD_PRICE} OR {BAD_PRIORITY})")
def g2_strict_gate(spark, sf_dir):
    """Rows known to be good pass a gate that would fail the job on any other."""
    df, record, spec = orders(spark, sf_dir)
    good = df.where(checks.schema_valid(record, spec))
    return require_accepted(gate(good, record, spec)).select("o_orderkey")


@query(f"SELECT event_id, {VALID_EVENT} AS is_valid FROM {EVENTS}")
def g3_lenient_gate(spark, sf_dir):
    gated = gate(events(spark, sf_dir), fields(), event_spec())
    return lenient(gated).select("event_id", "is_valid")


@query(
    f"""SELECT count(*) AS rows, count(*) FILTER ({ORDER_ERRORS} = 0) AS accepted,
               count(*) FILTER ({ORDER_ERRORS} > 0) AS rejected,
               count(*) FILTER ({BAD_STATUS} OR {BAD_PRIORITY}) AS enum_rows,
               count(*) FILTER ({ORDER_ERRORS} > 0) AS oneof_rows, 'unhealthy' AS status
        FROM orders"""
)
def quality_report_orders(spark, sf_dir):
    report = quality_report(gated_orders(spark, sf_dir), max_rejected_share=0.1)
    rules = F.map_from_entries("rules")
    return report.select(
        "rows", "accepted", "rejected", rules["enum"].alias("enum_rows"),
        rules["oneOf"].alias("oneof_rows"), "status",
    )


@query(
    """SELECT count(*) AS rows, 0 AS accepted, count(*) FILTER (l_returnflag <> 'N') AS enum_rows,
              count(*) FILTER (l_quantity > 25) AS maximum_rows, count(*) AS oneof_rows,
              count(*) AS required_rows FROM lineitem"""
)
def g6_report_many_errors(spark, sf_dir):
    """Rows with more than a dozen broken rules each; the report counts them all."""
    columns = ["l_orderkey", "l_quantity", "l_returnflag"]
    absent = {f"absent_{i:02}": "string" for i in range(12)}
    declared = {"l_orderkey": "int", "l_quantity": {"type": "float", "range": [0, 25]},
                "l_returnflag": {"type": "string", "enum": ["N"]}}
    spec = Spec.from_dict({"entities": {"Line": {"fields": absent | declared}}})
    df = table(spark, sf_dir, "lineitem").select(*columns)
    report = quality_report(gate(df, TypedRecord(df, columns), spec))
    rules = F.map_from_entries("rules")
    return report.select(
        "rows", "accepted", rules["enum"].alias("enum_rows"), rules["maximum"].alias("maximum_rows"),
        rules["oneOf"].alias("oneof_rows"), rules["required"].alias("required_rows"),
    )


@query(
    f"""SELECT count(*) AS rows, count(*) FILTER ({VALID_EVENT}) AS accepted,
               count(*) FILTER (NOT ({VALID_EVENT})) AS rejected FROM {EVENTS}"""
)
def g6_merged_batches(spark, sf_dir):
    """Each batch keeps what its report needs; the report of all adds that up."""
    path = scratch_path(spark, "reports")
    rows = events(spark, sf_dir)
    for batch in range(3):
        gated = gate(rows.where(F.pmod("event_id", F.lit(3)) == batch), fields(), event_spec())
        rule_counts(gated).write.mode("append").parquet(path)
    return report_of(spark.read.parquet(path)).select("rows", "accepted", "rejected")


@query(f"SELECT count(*) AS rows, count(*) FILTER ({VALID_EVENT}) AS accepted, "
       f"count(*) FILTER (NOT ({VALID_EVENT})) AS rejected FROM {EVENTS}")
def g7_observed_metrics(spark, sf_dir):
    """Metrics gathered while the gated rows are written."""
    gated = gate(events(spark, sf_dir), fields(), event_spec())
    observed, observation = observe_gate(gated, "events")
    observed.write.format("noop").mode("overwrite").save()
    counted = observation.get
    return spark.createDataFrame(
        [(counted["rows"], counted["accepted"], counted["rejected"])],
        "rows long, accepted long, rejected long",
    )


# --- records broken on purpose, and example pairs ----------------------------------------

# Each event's record as it is and broken in one way each; SQL of whether the result conforms.
MUTATIONS = {
    "as_is": (lambda k, props: props, "(k <= 60)::INT + (k >= 40)::INT = 1"),
    "dropped_key": (lambda k, props: F.lit('{"type":"Large"}'), "false"),
    "escaped_mark": (
        lambda k, props: F.concat(props, F.lit(',{"gristmill\\u003aend":0}')), "false"
    ),
    "half": (lambda k, props: F.expr("left(props, length(props) - 1)"), "false"),
    "in_a_list": (lambda k, props: F.concat(F.lit("["), props, F.lit("]")), "false"),
    "no_value": (lambda k, props: F.lit('{"k":null}'), "false"),
    "number_as_text": (lambda k, props: F.concat(F.lit('{"k":"'), k, F.lit('"}')), "false"),
    "plus_50": (
        lambda k, props: F.concat(F.lit('{"k":'), (k + 50).cast("string"), F.lit("}")),
        "(k + 50 <= 60)::INT + (k + 50 >= 40)::INT = 1",
    ),
    "tail": (lambda k, props: F.concat(props, F.lit(" ,")), "false"),
    "undeclared_key": (
        lambda k, props: F.concat(F.lit('{"k":'), k.cast("string"), F.lit(',"beside":[]}')), "false"
    ),
}


@query(
    "SELECT mutation, count(*) AS rows, count(*) FILTER (valid) AS conforming FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS mutation, {sql} AS valid FROM "
        "(SELECT regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events)"
        for name, (_, sql) in MUTATIONS.items()
    )
    + ") GROUP BY mutation"
)
def v18_mutated_events(spark, sf_dir):
    """Broken forms of every event's record, judged as texts."""
    df = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("mutation"), make(k, F.col("props")).alias("raw"))
            for name, (make, _) in MUTATIONS.items()
        ]
    )
    judged = with_record(df.select(F.inline(rows)), keep=["mutation"])
    valid = checks.schema_valid(fields(), event_spec())
    return judged.select("mutation", valid.alias("valid")).groupBy("mutation").agg(
        F.count("*").alias("rows"), F.count_if("valid").alias("conforming")
    )


@query(f"SELECT conv_id, turn, 'Answer' AS matched_entity, length(answer) >= 200 AS is_valid, "
       f"(length(answer) < 200)::INT AS n_errors FROM {PAIRS}")
def c5_example_pairs(spark, sf_dir):
    """Example pairs from conversations: the answer must conform, the declared length hold."""
    spec = Spec.from_dict(
        {
            "entities": {"Answer": {"fields": {"answer": "string"}}},
            "constraints": [{"expr": "len(answer) >= 200"}],
        }
    )
    df = pairs(spark, sf_dir).select(
        "conv_id", "turn", F.to_json(F.struct("answer")).alias("output")
    )
    checked = check_examples(df, spec)
    return checked.select(
        "conv_id", "turn", "matched_entity", (F.size("errors") == 0).alias("is_valid"),
        F.size("errors").alias("n_errors"),
    )
