"""Schema derivation and record validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill import Spec
from gristmill.catalog.registry import query, table
from gristmill.functions import checks
from gristmill.functions.record import TypedRecord, VariantRecord, look_up
from gristmill.operators.records import with_record
from gristmill.operators.schema import as_table, fill_defaults, read_as, route
from gristmill.operators.validation import (
    constraint_violations,
    python_validator,
    violations,
    violations_by_rule,
)

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def order_spec() -> Spec:
    return Spec.from_dict(
        {
            "name": "orders",
            "entities": {
                "Order": {
                    "fields": {
                        "o_orderkey": {"type": "int", "range": [0, 100_000_000_000]},
                        "o_custkey": "int",
                        "o_orderstatus": {"type": "string", "enum": ["O", "F"]},
                        "o_totalprice": {"type": "float", "range": [5000, 400000]},
                        "o_orderpriority": {
                            "type": "string",
                            "enum": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"],
                        },
                    }
                }
            },
            "constraints": [
                {"expr": "len(o_orderpriority) <= 8", "message": "long name", "severity": "warning"},
                {"expr": "o_totalprice > 10000"},
                {"expr": "o_orderstatus != 'P'", "severity": "info"},
                {"expr": "o_orderstatus in ['O']"},
            ],
        }
    )


BAD_STATUS = "o_orderstatus NOT IN ('O', 'F')"
BAD_PRICE = "NOT o_totalprice BETWEEN 5000 AND 400000"
BAD_PRIORITY = "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')"
ORDER_ERRORS = f"({BAD_STATUS})::INT + ({BAD_PRICE})::INT + ({BAD_PRIORITY})::INT"


def orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df, TypedRecord(df, ORDER_COLUMNS), order_spec()


def event_spec() -> Spec:
    """Two entities over the events' JSON: small numbers, and large numbers with a source."""
    return Spec.from_dict(
        {
            "entities": {
                "Small": {"fields": {"k": {"type": "int", "range": [0, 60]}}},
                "Large": {
                    "fields": {
                        "k": {"type": "int", "range": [40, 1000]},
                        "type": {"type": "string", "required": False},
                    }
                },
            },
            "constraints": [
                {"expr": "len(type) <= 5"},
                {"expr": "len(type) >= five"},
                {"expr": "k != 50"},
            ],
        }
    )


def events(spark, sf_dir):
    """Events as JSON records ``{"k": n}``, or with a type where it is a purchase or view.

    The number is written as an integer, a whole float, a fraction or a text by event type.
    """
    df = table(spark, sf_dir, "events")
    number = F.regexp_extract("props", "[0-9]+", 0)
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.col("props"))
        .when(kind == "view", F.concat(F.lit('{"type":"Small","k":'), number, F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit('{"k":'), number, F.lit(',"type":"Large"}')))
        .when(kind == "signup", F.concat(F.lit('{"k":'), number, F.lit(".0}")))
        .otherwise(F.concat(F.lit('{"k":"'), number, F.lit('","x":[1]}')))
    )
    return with_record(df.select("event_id", "event_type", raw.alias("raw")))


EVENTS = """(SELECT event_id, event_type, regexp_extract(props, '[0-9]+')::BIGINT AS k,
                    event_type IN ('click', 'view', 'purchase') AS whole,
                    event_type IN ('view', 'purchase') AS typed FROM events)"""


def fields():
    return VariantRecord(F.col("fields"))


# --- schema derivation -----------------------------------------------------------------


@query("SELECT event_id, event_type, value, NULL::BIGINT AS missing FROM events")
def o1_read_as_entity(spark, sf_dir):
    """JSON text through the derived schema; a value of the wrong type becomes null."""
    entity = Spec.from_dict(
        {
            "entities": {
                "Event": {
                    "fields": {"event_id": "int", "event_type": "string", "value": "float", "ts": "int"}
                }
            }
        }
    ).entities[0]
    df = table(spark, sf_dir, "events")
    raw = F.to_json(F.struct("event_id", "event_type", "value", F.lit("x").alias("ts")))
    return df.select(read_as(raw, entity).alias("e")).select(
        "e.event_id", "e.event_type", "e.value", F.col("e.ts").alias("missing")
    )


@query("SELECT o_orderkey, o_custkey, NULL::DOUBLE AS o_orderstatus, NULL::VARCHAR AS note FROM orders")
def o1_as_table(spark, sf_dir):
    entity = Spec.from_dict(
        {
            "entities": {
                "Order": {
                    "fields": {
                        "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "float",
                        "note": "string",
                    }
                }
            }
        }
    ).entities[0]
    return as_table(table(spark, sf_dir, "orders"), entity)


@query(
    """SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality, toxic::BIGINT AS toxic,
              'none' AS note FROM documents LEFT JOIN labels USING (doc_id)"""
)
def o2_fill_defaults(spark, sf_dir):
    entity = Spec.from_dict(
        {
            "entities": {
                "Label": {
                    "fields": {
                        "doc_id": "int",
                        "quality": {"type": "int", "default": -1},
                        "toxic": {"type": "int", "required": False},
                        "note": {"type": "string", "default": "none"},
                    }
                }
            }
        }
    ).entities[0]
    labels = table(spark, sf_dir, "labels")
    joined = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return fill_defaults(as_table(joined, entity), entity)


@query(
    f"""SELECT count(*) FILTER ({BAD_STATUS}) AS status_enum,
               count(*) FILTER (o_totalprice < 5000) AS price_minimum,
               count(*) FILTER (o_totalprice > 400000) AS price_maximum,
               count(*) FILTER ({BAD_PRIORITY}) AS priority_enum, count(*) AS rows FROM orders"""
)
def o3_row_checks(spark, sf_dir):
    df, record, spec = orders(spark, sf_dir)
    named = checks.schema_checks(record, spec.entities[0])
    return df.agg(
        F.count_if(~named["o_orderstatus.enum"]).alias("status_enum"),
        F.count_if(~named["o_totalprice.minimum"]).alias("price_minimum"),
        F.count_if(~named["o_totalprice.maximum"]).alias("price_maximum"),
        F.count_if(~named["o_orderpriority.enum"]).alias("priority_enum"),
        F.count_if(named["additionalProperties"]).alias("rows"),
    )


@query(
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'Small' ELSE 'Large' END AS entity
       FROM events WHERE event_type IN ('view', 'purchase')"""
)
def o4_route(spark, sf_dir):
    tables = route(events(spark, sf_dir), fields(), event_spec())
    small, large = (
        tables[name].select("event_id", F.lit(name).alias("entity")) for name in ("Small", "Large")
    )
    return small.unionByName(large)


# --- record validation -----------------------------------------------------------------


@query(
    """SELECT doc_id, 'quality' AS field FROM documents LEFT JOIN labels USING (doc_id)
       WHERE quality IS NULL"""
)
def v1_required(spark, sf_dir):
    """Null fields are left out of the JSON, so their keys are absent."""
    spec = Spec.from_dict(
        {"entities": {"Doc": {"fields": {"doc_id": "int", "quality": "int"}}}}
    ).entities[0]
    labels = table(spark, sf_dir, "labels")
    df = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    parsed = with_record(df, F.to_json(F.struct("doc_id", "quality")), keep=["doc_id"])
    found = checks.join_errors(checks.missing_required(fields(), spec))
    return violations(parsed, found, ["doc_id"]).select("doc_id", "field")


@query("SELECT event_id, 'x' AS field FROM events WHERE event_type = 'error' UNION ALL "
       "SELECT event_id, 'type' AS field FROM events WHERE event_type IN ('view', 'purchase')")
def v2_unknown(spark, sf_dir):
    df = events(spark, sf_dir)
    found = checks.unknown_fields(fields(), event_spec().entity("Small"))
    return violations(df, found, ["event_id"]).select("event_id", "field")


@query(
    """SELECT event_id, event_type IN ('click', 'view', 'purchase') AS int_ok,
              event_type <> 'error' AS float_ok, event_type = 'error' AS string_ok,
              false AS bool_ok FROM events"""
)
def v3_type(spark, sf_dir):
    df = events(spark, sf_dir)
    value = fields().value("k")
    return df.select(
        "event_id",
        *[checks.type_matches(value, t).alias(f"{t}_ok") for t in ("int", "float", "string", "bool")],
    )


@query(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {BAD_STATUS}")
def v4_enum(spark, sf_dir):
    df, record, spec = orders(spark, sf_dir)
    field = spec.entities[0].fields[2]
    return df.where(~checks.in_enum(record.value(field.name), field.enum)).select(
        "o_orderkey", "o_orderstatus"
    )


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def validate_customer(spark, sf_dir):
    """V5 on typed columns: balances outside the range."""
    df = table(spark, sf_dir, "customer")
    entity = Spec.from_dict(
        {
            "entities": {
                "Customer": {
                    "fields": {
                        "c_custkey": "int",
                        "c_acctbal": {"type": "float", "range": [0, 9000]},
                    }
                }
            }
        }
    ).entities[0]
    record = TypedRecord(df, ["c_custkey", "c_acctbal"])
    found = checks.join_errors(checks.field_errors(record, entity, entity.fields[1]))
    return violations(df, found, ["c_custkey", "c_acctbal"]).select("c_custkey", "c_acctbal")


@query(
    f"""SELECT event_id, 'type' AS rule FROM {EVENTS} WHERE NOT whole UNION ALL
        SELECT event_id, 'range' FROM {EVENTS} WHERE event_type <> 'error' AND k > 60 UNION ALL
        SELECT event_id, 'range_type' FROM {EVENTS} WHERE event_type = 'error'"""
)
def v5_range_json(spark, sf_dir):
    """The range applies to any number; a text in a range is an error, not a failed job."""
    df = events(spark, sf_dir)
    entity = event_spec().entity("Small")
    found = checks.join_errors(checks.field_errors(fields(), entity, entity.fields[0]))
    return violations(df, found, ["event_id"]).select("event_id", "rule")


@query(f"SELECT o_orderkey, {ORDER_ERRORS} AS n_errors, {ORDER_ERRORS} = 0 AS clean FROM orders")
def validate_orders(spark, sf_dir):
    """V6 on typed columns."""
    df, record, spec = orders(spark, sf_dir)
    entity = spec.entities[0]
    return df.select(
        "o_orderkey",
        F.size(checks.entity_errors(record, entity)).alias("n_errors"),
        checks.entity_clean(record, entity).alias("clean"),
    )


@query(
    f"""SELECT 'enum' AS rule, 'o_orderstatus' AS field, count(*) AS n FROM orders WHERE {BAD_STATUS}
        UNION ALL SELECT 'range', 'o_totalprice', count(*) FROM orders WHERE {BAD_PRICE}
        UNION ALL SELECT 'enum', 'o_orderpriority', count(*) FROM orders WHERE {BAD_PRIORITY}"""
)
def violations_by_rule_report(spark, sf_dir):
    df, record, spec = orders(spark, sf_dir)
    found = checks.entity_errors(record, spec.entities[0])
    return violations_by_rule(df, found).select("rule", "field", "n")


@query(
    f"""SELECT event_id, CASE WHEN whole AND NOT typed AND k <= 60 THEN 'Small'
                             WHEN whole AND k >= 40 THEN 'Large' END AS matched,
               (CASE WHEN whole AND NOT typed AND k <= 60 THEN 0
                     ELSE typed::INT + (event_type = 'error')::INT + (NOT whole)::INT
                          + (event_type = 'error' OR k > 60)::INT
                          + CASE WHEN whole AND k >= 40 THEN 0
                                 ELSE 1 + (event_type = 'error')::INT + (NOT whole)::INT
                                      + (event_type = 'error' OR k < 40)::INT END
                END + typed::INT) AS n_errors
        FROM {EVENTS}"""
)
def v7_matched_entity(spark, sf_dir):
    """Errors of entities tried before the match stay; the second constraint has no number."""
    df = events(spark, sf_dir)
    record, spec = fields(), event_spec()
    return df.select(
        "event_id",
        checks.matched_entity(record, spec).alias("matched"),
        F.size(checks.ontology_errors(record, spec)).alias("n_errors"),
    )


@query(
    f"SELECT event_id, 'constraint_error' AS rule FROM {EVENTS} WHERE typed"
)
def v8_simple_constraints(spark, sf_dir):
    df = events(spark, sf_dir)
    record, spec = fields(), event_spec()
    found = checks.join_errors(checks.simple_constraint_errors(record, c) for c in spec.constraints)
    return violations(df, found, ["event_id"]).select("event_id", "rule")


@query("SELECT doc_id, length(text) >= 300 AS long, length(text) < 2000 AS short FROM documents")
def v9_length_rule(spark, sf_dir):
    spec = Spec.from_dict({"constraints": [{"expr": "len(text) >= 300"}, {"expr": "len(text) < 2000"}]})
    df = table(spark, sf_dir, "documents")
    record = TypedRecord(df, ["text"])
    long, short = (checks.constraint_holds(record, c) for c in spec.constraints)
    return df.select("doc_id", long.alias("long"), short.alias("short"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount <= 0.05 AS discount,
              l_quantity <> 7 AS quantity, l_returnflag > 'A' AS flag, true AS unreadable
       FROM lineitem"""
)
def v10_comparison(spark, sf_dir):
    spec = Spec.from_dict(
        {
            "constraints": [
                {"expr": "l_discount <= 0.05"},
                {"expr": "l_quantity != 7"},
                {"expr": "l_returnflag > 'A'"},
                {"expr": "l_quantity >= many"},
            ]
        }
    )
    df = table(spark, sf_dir, "lineitem")
    record = TypedRecord(df)
    names = ["discount", "quantity", "flag", "unreadable"]
    holds = [checks.constraint_holds(record, c).alias(n) for c, n in zip(spec.constraints, names, strict=True)]
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *holds)


@query(
    """SELECT l_returnflag, count(*) AS n,
              count(*) FILTER (l_quantity <= 45 AND l_tax < 0.07 AND l_linestatus = 'F') AS ok,
              sum((l_quantity > 45)::INT + (l_tax >= 0.07)::INT + (l_linestatus <> 'F')::INT)::BIGINT
                  AS failed
       FROM lineitem GROUP BY l_returnflag"""
)
def constraint_failures(spark, sf_dir):
    """V11 over the largest table."""
    spec = Spec.from_dict(
        {
            "constraints": [
                {"expr": "l_quantity <= 45"},
                {"expr": "l_tax < 0.07"},
                {"expr": "l_linestatus == 'F'"},
                {"expr": "l_linestatus in ['O']"},
            ]
        }
    )
    df = table(spark, sf_dir, "lineitem")
    record = TypedRecord(df)
    judged = df.select(
        "l_returnflag",
        checks.constraints_hold(record, spec.constraints).alias("ok"),
        F.size(checks.constraint_errors(record, spec.constraints)).alias("failed"),
    )
    return judged.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.sum("failed").alias("failed")
    )


@query(
    f"""SELECT event_id, event_type <> 'error'
               AND ((NOT typed AND k <= 60)::INT + (k >= 40)::INT) = 1 AS valid,
               CASE WHEN event_type = 'error' THEN 'oneOf'
                    WHEN (NOT typed AND k <= 60) AND k >= 40 THEN 'oneOf'
                    WHEN typed AND k < 40 THEN 'oneOf' END AS last_rule
        FROM {EVENTS}"""
)
def validate_event_props(spark, sf_dir):
    """V12: exactly one entity; whole floats are integers here, two matches are an error."""
    spec = event_spec()
    df, record = look_up(events(spark, sf_dir), fields(), spec.field_names)
    judged = df.withColumn("valid", checks.schema_valid(record, spec))
    errors = checks.schema_errors(record, spec, valid=F.col("valid"))
    last = F.try_element_at(F.col("errors"), F.lit(-1))["rule"]
    return judged.select("event_id", "valid", errors.alias("errors")).select(
        "event_id", "valid", last.alias("last_rule")
    )


@query(
    f"""SELECT event_id, event_type IN ('view', 'purchase') AND (k < 40 OR k > 60) AS valid FROM {EVENTS}"""
)
def v13_envelope(spark, sf_dir):
    """The type names any entity, whichever the data satisfies."""
    df = events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", F.lit('"Large"')).when(
        F.col("event_type") == "purchase", F.lit('"Small"')
    ).when(F.col("event_type") == "click", F.lit('"Other"')).otherwise(F.lit("1"))
    number = F.regexp_extract("raw", "[0-9]+", 0)
    text = F.concat(F.lit('{"type":'), kind, F.lit(',"data":{"k":'), number, F.lit('},"more":null}'))
    parsed = with_record(df, text, keep=["event_id"])
    return parsed.select("event_id", checks.envelope_valid(F.col("fields"), event_spec()).alias("valid"))


@query("SELECT event_id, event_type IN ('click', 'view', 'purchase') AS valid FROM events")
def v14_light_match(spark, sf_dir):
    df = events(spark, sf_dir)
    return df.select("event_id", checks.light_valid(fields(), event_spec()).alias("valid"))


@query("SELECT event_id, 'name' AS field FROM events WHERE event_type = 'view'")
def v15_typed_required(spark, sf_dir):
    spec = Spec.from_dict(
        {
            "entities": {
                "Small": {"fields": {"k": "int", "name": "string"}},
                "Large": {"fields": {"k": "int"}},
            }
        }
    )
    found = checks.typed_required_errors(fields(), spec)
    return violations(events(spark, sf_dir), found, ["event_id"]).select("event_id", "field")


@query(
    f"""SELECT event_id, 'maximum' AS rule FROM {EVENTS} WHERE event_type = 'view' AND k > 60
        UNION ALL
        SELECT event_id, 'minimum' FROM {EVENTS} WHERE event_type = 'purchase' AND k < 40"""
)
def v16_field_constraints(spark, sf_dir):
    found = checks.typed_constraint_errors(fields(), event_spec())
    return violations(events(spark, sf_dir), found, ["event_id"]).select("event_id", "rule")


@query(
    f"""SELECT event_id, event_type <> 'error' AND ((NOT typed AND k <= 60)::INT + (k >= 40)::INT) = 1
               AND NOT (event_type = 'view' AND k > 60) AND NOT (event_type = 'purchase' AND k < 40)
               AND k % 2 = 0 AS ok
        FROM {EVENTS}"""
)
def v17_validate_output(spark, sf_dir):
    record, spec = fields(), event_spec()
    custom = {"even": record.value("k").number % 2 == 0}
    found = checks.output_errors(record, spec, custom=custom)
    return events(spark, sf_dir).select("event_id", (F.size(found) == 0).alias("ok"))


@query(
    """SELECT event_id, event_type = 'click' AND regexp_extract(props, '[0-9]+')::INT NOT BETWEEN 40 AND 60
           AS valid FROM events"""
)
def v18_validate_text(spark, sf_dir):
    """Texts that are no JSON, or JSON but no object, are invalid rather than null."""
    df = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.col("props"))
        .when(kind == "view", F.concat("props", F.lit(" }")))
        .when(kind == "purchase", F.concat(F.lit("["), "props", F.lit("]")))
        .when(kind == "signup", F.concat(F.lit("not "), "props"))
    )
    record = VariantRecord(F.col("fields"))
    parsed = with_record(df, text, keep=["event_id"])
    return parsed.select("event_id", checks.schema_valid(record, event_spec()).alias("valid"))


@query(
    """SELECT o_orderkey, 'len(o_orderpriority) <= 8' AS "constraint", 'warning' AS severity,
              'long name' AS message FROM orders WHERE length(o_orderpriority) > 8
       UNION ALL SELECT o_orderkey, 'o_totalprice > 10000', 'error', NULL FROM orders
           WHERE o_totalprice <= 10000
       UNION ALL SELECT o_orderkey, 'o_orderstatus != ''P''', 'info', NULL FROM orders
           WHERE o_orderstatus = 'P'"""
)
def v19_severity(spark, sf_dir):
    df, record, spec = orders(spark, sf_dir)
    return constraint_violations(df, record, spec.constraints, ["o_orderkey"])


@query(
    f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'the check gave no answer'
                              ELSE 'the check said no' END AS message,
               CASE WHEN event_type = 'error' THEN 'TypeError' END AS problem
        FROM {EVENTS} WHERE event_type = 'error' OR k % 3 <> 0"""
)
def u2_custom_validator(spark, sf_dir):
    """A Python check of batches; a record on which it raises has an error that tells why."""
    df = events(spark, sf_dir)
    divisible = python_validator(lambda records: [int(r["k"] / 1) % 3 == 0 for r in records])
    found = checks.custom_errors({"divisible": F.col("verdict.ok")})
    judged = df.withColumn("verdict", divisible(F.col("raw")))
    told = judged.withColumn("problem", F.substring_index("verdict.problem", ":", 1))
    return violations(told, found, ["event_id", "problem"]).select("event_id", "message", "problem")
