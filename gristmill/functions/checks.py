"""Record checks as Columns: errors as arrays, verdicts as booleans.

An error is ``STRUCT<rule, entity, field, message>``. Error arrays are built by ``concat`` of
conditional one-element arrays, so a clean row allocates nothing but an empty array and the
expression stays in generated code.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.json_text import as_record
from gristmill.functions.record import (
    TypedRecord,
    Value,
    VariantRecord,
    false,
    is_true,
    true,
)
from gristmill.spec import CompareRule, Constraint, Entity, Field, LengthRule, Spec

Record = TypedRecord | VariantRecord

ERROR_TYPE = "struct<rule:string,entity:string,field:string,message:string>"
ERRORS_TYPE = f"array<{ERROR_TYPE}>"

OPERATORS = {
    "<=": operator.le,
    ">=": operator.ge,
    "<": operator.lt,
    ">": operator.gt,
    "==": operator.eq,
    "!=": operator.ne,
}


def no_errors() -> Column:
    return F.array().cast(ERRORS_TYPE)


def error(rule: str, entity: str | None, field: str | Column | None, message: str | Column) -> Column:
    def text(part: str | Column | None, name: str) -> Column:
        column = part if isinstance(part, Column) else F.lit(part)
        return (column.cast("string") if part is None else column).alias(name)

    return F.struct(
        text(rule, "rule"), text(entity, "entity"), text(field, "field"), text(message, "message")
    )


def error_if(condition: Column, *parts) -> Column:
    return F.when(condition, F.array(error(*parts))).otherwise(no_errors())


def join_errors(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    return F.concat(*parts) if parts else no_errors()


def all_of(conditions: Iterable[Column]) -> Column:
    result = true()
    for condition in conditions:
        result = result & condition
    return result


def any_of(conditions: Iterable[Column]) -> Column:
    result = false()
    for condition in conditions:
        result = result | condition
    return result


def _below(value: Value, limit: float) -> Column:
    return is_true(value.number < value.bound(limit))


def _above(value: Value, limit: float) -> Column:
    """Spark orders NaN above every number; in Python it is above none."""
    return is_true(value.number > value.bound(limit)) & ~value.is_nan


# --- record validation -----------------------------------------------------------------


def missing_required(record: Record, entity: Entity) -> list[Column]:
    """A required key must be present; a null value is enough."""
    return [
        error_if(
            ~record.value(name).present,
            "required", entity.name, name, f"{name} is required but absent",
        )
        for name in entity.required_names
    ]


def unknown_fields(record: Record, entity: Entity) -> Column:
    """One error for each key the entity does not declare."""
    unknown = F.transform(
        record.unknown_keys(entity.field_names),
        lambda key: error(
            "unknown", entity.name, key, F.concat(F.lit("not declared: "), key)
        ),
    )
    return F.when(record.has_unknown_keys(entity.field_names), unknown).otherwise(no_errors())


def type_matches(value: Value, declared: str) -> Column:
    """Scalar types as Python's isinstance sees them; list types are not checked."""
    if declared == "string":
        return value.is_text
    if declared == "int":
        return value.is_int | value.is_bool
    if declared == "float":
        return value.is_numeric
    if declared == "bool":
        return value.is_bool
    return true()


def in_enum(value: Value, choices: Iterable[str]) -> Column:
    return is_true(value.text.isin(*choices))


def field_errors(record: Record, entity: Entity, field: Field) -> list[Column]:
    """Type, enum and range of one field, where its key is present."""
    value = record.value(field.name)
    found = [
        error_if(
            value.present & ~type_matches(value, field.type),
            "type", entity.name, field.name, f"{field.name} is not of type {field.type}",
        )
    ]
    if field.enum is not None:
        found.append(
            error_if(
                value.present & ~in_enum(value, field.enum),
                "enum", entity.name, field.name,
                f"{field.name} is none of {', '.join(field.enum)}",
            )
        )
    if field.range is not None:
        low, high = field.range
        found.append(
            error_if(
                value.present & value.is_numeric & (_below(value, low) | _above(value, high)),
                "range", entity.name, field.name,
                f"{field.name} lies outside {low} to {high}",
            )
        )
        found.append(
            error_if(
                value.present & ~value.is_numeric,
                "range_type", entity.name, field.name,
                f"{field.name} is no number, its range cannot be judged",
            )
        )
    return found


def entity_errors(record: Record, entity: Entity) -> Column:
    """All errors of a record against one entity: required, unknown, then field checks."""
    parts = missing_required(record, entity)
    parts.append(unknown_fields(record, entity))
    for field in entity.fields:
        parts.extend(field_errors(record, entity, field))
    return join_errors(parts)


def entity_clean(record: Record, entity: Entity) -> Column:
    """``size(entity_errors) = 0`` without building the errors."""
    tests = [record.value(name).present for name in entity.required_names]
    tests.append(~record.has_unknown_keys(entity.field_names))
    for field in entity.fields:
        value = record.value(field.name)
        ok = type_matches(value, field.type)
        if field.enum is not None:
            ok = ok & in_enum(value, field.enum)
        if field.range is not None:
            low, high = field.range
            ok = ok & value.is_numeric & ~_below(value, low) & ~_above(value, high)
        tests.append(~value.present | ok)
    return record.is_object & all_of(tests)


def simple_constraint_errors(record: Record, constraint: Constraint) -> Column:
    """Record validation reads only ``len(f) <= n`` and ``len(f) >= n`` on string fields."""
    rule = constraint.simple_length
    if rule is None:
        return no_errors()
    value = record.value(rule.field)
    applies = value.present & value.is_text
    try:
        limit = int(rule.number)
    except ValueError:
        return error_if(
            applies, "constraint_error", None, rule.field,
            f"cannot be evaluated: {constraint.expr}",
        )
    holds = OPERATORS[rule.op](F.length(value.text), F.lit(limit))
    return error_if(
        applies & ~is_true(holds),
        "constraint", None, rule.field, f"does not hold: {constraint.expr}",
    )


def matched_entity(record: Record, spec: Spec) -> Column:
    """The first entity, in declaration order, the record satisfies; null for none."""
    result = F.lit(None).cast("string")
    for entity in reversed(spec.entities):
        result = F.when(entity_clean(record, entity), F.lit(entity.name)).otherwise(result)
    return result


def ontology_errors(record: Record, spec: Spec) -> Column:
    """Errors of the entities tried up to the first match, then of the constraints."""
    tried = error_if(true(), "no_entity", None, None, "no entity of the spec fits")
    for entity in reversed(spec.entities):
        found = entity_errors(record, entity)
        tried = F.when(entity_clean(record, entity), no_errors()).otherwise(
            F.concat(found, tried)
        )
    constraints = [simple_constraint_errors(record, c) for c in spec.constraints]
    return join_errors([tried, *constraints])


def ontology_valid(record: Record, spec: Spec) -> Column:
    """The record matches an entity and breaks no constraint."""
    broken = [F.size(simple_constraint_errors(record, c)) > 0 for c in spec.constraints]
    return any_of(entity_clean(record, e) for e in spec.entities) & ~any_of(broken)


# --- constraint language ---------------------------------------------------------------


def length_holds(record: Record, rule: LengthRule) -> Column:
    """``len(field) op n`` on string fields; true where it does not apply."""
    if rule.op not in ("<=", ">=", "<", ">"):
        return true()
    value = record.value(rule.field)
    return F.coalesce(OPERATORS[rule.op](F.length(value.text), F.lit(int(rule.number))), F.lit(True))


def compare_holds(record: Record, rule: CompareRule) -> Column:
    """``field op value``; true where the field is missing or cannot be compared."""
    if rule.op not in OPERATORS:
        return true()
    compare = OPERATORS[rule.op]
    value = record.value(rule.field)
    ordering = rule.op not in ("==", "!=")

    try:
        limit = float(rule.value)
    except ValueError:
        numeric = true()
    else:
        if math.isnan(limit):
            numeric = F.lit(rule.op == "!=")
        else:
            numeric = F.when(value.is_nan, F.lit(rule.op == "!=")).otherwise(
                compare(value.number, value.bound(limit))
            )
    text = compare(value.text, F.lit(rule.value.strip("\"'")))
    other = F.lit(ordering or rule.op == "!=")
    return (
        F.when(~value.present, F.lit(True))
        .when(value.is_numeric, numeric)
        .when(value.is_text, text)
        .otherwise(other)
    )


def constraint_holds(record: Record, constraint: Constraint) -> Column:
    rule = constraint.rule
    if isinstance(rule, LengthRule):
        return length_holds(record, rule)
    if isinstance(rule, CompareRule):
        return compare_holds(record, rule)
    return true()


def constraint_errors(record: Record, constraints: Iterable[Constraint]) -> Column:
    return join_errors(
        error_if(
            ~constraint_holds(record, c),
            "constraint", None, getattr(c.rule, "field", None), f"Constraint failed: {c.expr}",
        )
        for c in constraints
    )


def constraints_hold(record: Record, constraints: Iterable[Constraint]) -> Column:
    return all_of(constraint_holds(record, c) for c in constraints)


# --- JSON schema (draft 7) semantics ---------------------------------------------------


def json_type_matches(value: Value, json_type: str, item_type: str | None) -> Column:
    """JSON types: a bool is no number, a whole float is an integer, items are checked."""
    if json_type == "string":
        return value.is_text
    if json_type == "integer":
        whole = value.is_float & is_true(value.number == F.floor(value.number))
        return value.is_int | whole
    if json_type == "number":
        return value.is_int | value.is_float
    if json_type == "boolean":
        return value.is_bool
    return value.is_list & value.items_are(item_type)


def _value_tests(value: Value, field: Field, number: Column) -> list[tuple[str, Column]]:
    """(rule, ok) for what a field's declaration says of a value that is there."""
    tests = []
    if field.enum:
        tests.append(("enum", ~value.present | in_enum(value, field.enum)))
    if field.json_range:
        low, high = field.json_range
        tests.append(("minimum", ~(value.present & number & _below(value, low))))
        tests.append(("maximum", ~(value.present & number & _above(value, high))))
    return tests


def _schema_tests(record: Record, entity: Entity) -> list[tuple[str, str, Column]]:
    """(rule, field, ok) for every condition the entity's JSON schema states."""
    tests = []
    for field in entity.fields:
        value = record.value(field.name)
        if field.required:
            tests.append(("required", field.name, value.present))
        typed = json_type_matches(value, field.json_type, field.item_type)
        tests.append(("type", field.name, ~value.present | typed))
        stated = _value_tests(value, field, value.is_int | value.is_float)
        tests += [(rule, field.name, ok) for rule, ok in stated]
    return tests


def schema_checks(record: Record, entity: Entity) -> dict[str, Column]:
    """Row checks of an entity by name, such as ``age.minimum``; all true means conforming."""
    checks = {f"{name}.{rule}": ok for rule, name, ok in _schema_tests(record, entity)}
    checks["additionalProperties"] = ~record.has_unknown_keys(entity.field_names)
    return checks


def schema_matches(record: Record, entity: Entity) -> Column:
    return record.is_object & all_of(schema_checks(record, entity).values())


def _exactly_one(matches: Sequence[Column]) -> Column:
    return sum((m.cast("int") for m in matches), start=F.lit(0)) == 1


def schema_valid(record: Record, spec: Spec) -> Column:
    """The record satisfies exactly one entity."""
    return _exactly_one([schema_matches(record, e) for e in spec.entities])


def schema_entity_errors(record: Record, entity: Entity) -> Column:
    return _schema_entity_errors(record, entity, _schema_tests(record, entity))


def _schema_entity_errors(
    record: Record, entity: Entity, tests: Sequence[tuple[str, str, Column]]
) -> Column:
    parts = [
        error_if(~ok, rule, entity.name, name, f"{entity.name}.{name}: {rule} check failed")
        for rule, name, ok in tests
    ]
    extra = F.transform(
        record.unknown_keys(entity.field_names),
        lambda key: error(
            "additionalProperties", entity.name, key, F.concat(F.lit("Unexpected key: "), key)
        ),
    )
    parts.append(
        F.when(record.has_unknown_keys(entity.field_names), extra).otherwise(no_errors())
    )
    return join_errors(parts)


def schema_errors(record: Record, spec: Spec, valid: Column | None = None) -> Column:
    """Empty for a valid record; else the errors of every entity, or the ambiguity.

    ``valid`` may give the verdict where it is already a column, so it is not worked out again.
    """
    tests = {e.name: _schema_tests(record, e) for e in spec.entities}
    matches = [
        all_of(ok for _, _, ok in tests[e.name]) & ~record.has_unknown_keys(e.field_names)
        for e in spec.entities
    ]
    per_entity = join_errors(_schema_entity_errors(record, e, tests[e.name]) for e in spec.entities)
    none = F.array(error("oneOf", None, None, "Matches no entity"))
    several = F.array(error("oneOf", None, None, "Matches more than one entity"))
    if valid is None:
        valid = record.is_object & _exactly_one(matches)
    return (
        F.when(valid, no_errors())
        .when(~record.is_object, F.array(error("object", None, None, "the record is no object")))
        .when(any_of(matches), several)
        .otherwise(F.concat(per_entity, none))
    )


def light_matches(record: Record, entity: Entity) -> Column:
    """Required keys and top-level types only; extra keys, enums and ranges are ignored."""
    tests = [record.value(name).present for name in entity.required_names]
    for field in entity.fields:
        value = record.value(field.name)
        typed = {
            "string": value.is_text,
            "integer": value.is_int | value.is_bool,
            "number": value.is_numeric,
            "boolean": value.is_bool,
            "array": value.is_list,
        }[field.json_type]
        tests.append(~value.present | typed)
    return record.is_object & all_of(tests)


def light_valid(record: Record, spec: Spec) -> Column:
    return any_of(light_matches(record, e) for e in spec.entities)


# --- model output ----------------------------------------------------------------------


def typed_required_errors(record: Record, spec: Spec) -> Column:
    """A record whose ``type`` names an entity must have that entity's required keys."""
    kind = record.value("type").text
    return join_errors(
        F.when(is_true(kind == e.name), join_errors(missing_required(record, e))).otherwise(
            no_errors()
        )
        for e in spec.entities
    )


def length_tests(value: Value, field: Field) -> list[tuple[str, Column]]:
    """(rule, ok) for the length bounds of a string field; a bound of zero bounds nothing."""
    if field.json_type != "string":
        return []
    n = F.length(value.text)
    bounds = {"minLength": (field.min_length, n < F.lit(field.min_length)),
              "maxLength": (field.max_length, n > F.lit(field.max_length))}
    return [(rule, ~is_true(broken)) for rule, (bound, broken) in bounds.items() if bound]


def field_constraint_errors(record: Record, entity: Entity) -> Column:
    """Enum, numeric range and string length of the entity's fields, in the order of the spec.

    The same tests as the entity's schema states, but a bool counts as a number here.
    """
    parts = []
    for field in entity.fields:
        value = record.value(field.name)
        for rule, ok in _value_tests(value, field, value.is_numeric) + length_tests(value, field):
            parts.append(error_if(~ok, rule, entity.name, field.name, f"{field.name} breaks its {rule}"))
    return join_errors(parts)


def typed_constraint_errors(record: Record, spec: Spec) -> Column:
    """Field constraints of the entity that ``type`` names."""
    kind = record.value("type").text
    return join_errors(
        F.when(is_true(kind == e.name), field_constraint_errors(record, e)).otherwise(no_errors())
        for e in spec.entities
    )


def custom_errors(validators: dict[str, Column]) -> Column:
    """User rules: a false result is an error, and so is null, the result of a failed check."""
    message = {False: "the check said no", True: "the check gave no answer"}
    return join_errors(
        error_if(
            ~is_true(check), "custom", None, name,
            F.when(check.isNull(), message[True]).otherwise(message[False]),
        )
        for name, check in validators.items()
    )


def output_errors(
    record: Record,
    spec: Spec,
    *,
    schema: bool = True,
    grammar: bool = True,
    custom: dict[str, Column] | None = None,
) -> Column:
    """Errors of a model's output: schema, typed-field and user checks, each switchable."""
    parts = []
    if schema:
        parts.append(schema_errors(record, spec))
    if grammar:
        parts.append(typed_required_errors(record, spec))
        parts.append(typed_constraint_errors(record, spec))
        if not schema:
            parts.append(error_if(~record.is_object, "object", None, None, "the record is no object"))
    if custom:
        parts.append(custom_errors(custom))
    return join_errors(parts)


# --- envelopes -------------------------------------------------------------------------


def envelope_valid(fields: Column, spec: Spec) -> Column:
    """``{"type": <entity name>, "data": <record satisfying exactly one entity>}``.

    The type is not tied to the entity the data satisfies.
    """
    envelope = VariantRecord(fields)
    data = envelope.value("data")
    kind = envelope.value("type")
    return (
        kind.present
        & in_enum(kind, spec.entity_names)
        & data.present
        & schema_valid(VariantRecord(as_record(data.raw)), spec)
    )


def is_entity(record: Record, name: str) -> Column:
    """The record's ``type`` is the entity's name."""
    return record.is_object & is_true(record.value("type").text == name)
