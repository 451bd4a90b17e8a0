"""Rows that satisfy a spec, and rows that do not, for property checks at volume.

Every value is a function of seed, row key and field name, so a job that loses executors
recomputes the same rows, and two runs agree.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.checks import (
    matched_entity,
    ontology_errors,
    schema_errors,
    schema_valid,
)
from gristmill.functions.record import VariantRecord
from gristmill.operators.records import with_record
from gristmill.spec import Entity, Field, Spec

# Texts that are no record of any spec, and a pair no spec declares.
MALFORMED = ("17", '["k"]', '{"half":', '{"unheard_of":[]}')
EXTRA_KEY = '"beside_the_spec":{}'


def draw(key: Column, label: str, seed: int) -> Column:
    """32 hex digits, different for every row, label and seed."""
    return F.md5(F.concat(F.lit(f"{seed}:{label}:"), key.cast("string")))


def draw_int(key: Column, label: str, seed: int) -> Column:
    """A number from 0 to 2**32 - 1."""
    return F.conv(F.substring(draw(key, label, seed), 1, 8), 16, 10).cast("long")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _scalar(json_type: str, key: Column, label: str, seed: int) -> Column:
    number = draw_int(key, label, seed)
    if json_type == "string":
        return _quoted(draw(key, label, seed))
    if json_type == "boolean":
        return (number % 2 == 1).cast("string")
    if json_type == "integer":
        return (number - 2**31).cast("string")
    return F.concat((number - 2**31).cast("string"), F.lit(".5"))


def _value(field: Field, key: Column, label: str, seed: int) -> Column:
    """JSON text of a value the field's schema accepts."""
    if field.enum:
        choices = F.array(*[F.lit(json.dumps(c, ensure_ascii=False)) for c in field.enum])
        return F.get(choices, (draw_int(key, label, seed) % len(field.enum)).cast("int"))
    if field.json_type == "array":
        items = [_scalar(field.item_type, key, f"{label}[{i}]", seed) for i in range(3)]
        count = (draw_int(key, label, seed) % 4).cast("int")
        return F.concat(
            F.lit("["), F.array_join(F.slice(F.array(*items), F.lit(1), count), ","), F.lit("]")
        )
    if field.json_range:
        low, high = field.json_range
        unit = 1 if field.type == "int" else 100
        first, steps = _grid(low, high, unit)
        step = draw_int(key, label, seed) % F.lit(steps)
        if unit == 1:
            return (F.lit(first) + step).cast("string")
        return ((F.lit(first) + step).cast("decimal(20,0)") / unit).cast("decimal(20,2)").cast("string")
    return _scalar(field.json_type, key, label, seed)


def _grid(low: float, high: float, unit: int) -> tuple[int, int]:
    """First multiple of 1/unit in the range, and how many there are."""
    first = -int(-low * unit // 1)
    steps = int(high * unit // 1) - first + 1
    if steps < 1:
        raise ValueError(f"range [{low}, {high}] holds no value with {unit} steps to the unit")
    return first, steps


def _pairs(entity: Entity, key: Column, seed: int) -> dict[str, Column]:
    """``"name":value`` per field; optional fields are null for about half of the rows."""
    pairs = {}
    for field in entity.fields:
        label = f"{entity.name}.{field.name}"
        pair = F.concat(F.lit(f"{json.dumps(field.name)}:"), _value(field, key, label, seed))
        if not field.required:
            pair = F.when(draw_int(key, f"{label}?", seed) % 2 == 0, pair)
        pairs[field.name] = pair
    return pairs


def _object(pairs: dict[str, Column] | list[Column]) -> Column:
    parts = list(pairs.values()) if isinstance(pairs, dict) else pairs
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def conforming(key: Column, entity: Entity, seed: int = 42) -> Column:
    """JSON text of a row that satisfies the entity."""
    return _object(_pairs(entity, key, seed))


def conforming_any(key: Column, spec: Spec, seed: int = 42) -> Column:
    """JSON text of a row that satisfies one of the entities."""
    choice = draw_int(key, "entity", seed) % len(spec.entities)
    raw = F.lit(None).cast("string")
    for position, entity in enumerate(spec.entities):
        raw = F.when(choice == position, conforming(key, entity, seed)).otherwise(raw)
    return raw


def nonconforming(pairs: dict[str, Column], key: Column, entity: Entity, seed: int = 42) -> dict[str, Column]:
    """JSON texts that break the entity in one way each, and texts that are no records.

    ``pairs`` are the conforming ``"name":value`` texts the broken ones are made from.
    """

    def without(name: str) -> Column:
        return _object({n: p for n, p in pairs.items() if n != name})

    def replaced(name: str, value: str) -> Column:
        return _object({**pairs, name: F.lit(f"{json.dumps(name)}:{value}")})

    broken = {"extra_key": _object([*pairs.values(), F.lit(EXTRA_KEY)])}
    for field in entity.fields:
        name = field.name
        if field.required:
            broken[f"drop:{name}"] = without(name)
        broken[f"retype:{name}"] = replaced(name, "0" if field.json_type == "string" else '"x"')
        if field.enum:
            broken[f"enum:{name}"] = replaced(name, json.dumps("\u0001".join(field.enum)))
        if field.json_range:
            low, high = field.json_range
            broken[f"below:{name}"] = replaced(name, repr(low - 1))
            broken[f"above:{name}"] = replaced(name, repr(high + 1))
    broken["empty"] = F.lit("{}")
    broken["random_dict"] = F.concat(
        F.lit("{"), _quoted(draw(key, "k", seed)), F.lit(":"), _quoted(draw(key, "v", seed)), F.lit("}")
    )
    broken["random_text"] = F.concat(F.lit("~"), draw(key, "text", seed))
    for position, text in enumerate(MALFORMED):
        broken[f"malformed:{position}"] = F.lit(text)
    return broken


def generate(keys: DataFrame, key: str, spec: Spec, seed: int = 42) -> DataFrame:
    """One conforming row per key."""
    return keys.select(key, conforming_any(F.col(key), spec, seed).alias("raw"))


def generate_broken(keys: DataFrame, key: str, entity: Entity, seed: int = 42) -> DataFrame:
    """One row per key and way of breaking the entity: ``mutation``, ``raw``."""
    drawn = [p.alias(f"_pair_{name}") for name, p in _pairs(entity, F.col(key), seed).items()]
    pairs = {f.name: F.col(f"_pair_{f.name}") for f in entity.fields}
    cases = nonconforming(pairs, F.col(key), entity, seed)
    rows = F.array(
        *[F.struct(F.lit(n).alias("mutation"), raw.alias("raw")) for n, raw in cases.items()]
    )
    return keys.select(key, *drawn).select(key, F.inline(rows))


def failures(rows: DataFrame, spec: Spec) -> DataFrame:
    """Generated rows with their verdict: zero invalid ones is the property."""
    parsed = with_record(rows)
    record = VariantRecord(F.col("fields"))
    judged = parsed.withColumn("is_valid", schema_valid(record, spec))
    return judged.withColumn("errors", schema_errors(record, spec, valid=F.col("is_valid")))


def check_examples(pairs: DataFrame, spec: Spec, output: str = "output") -> DataFrame:
    """Example pairs with a verdict on their output: the entity it matches, or none."""
    record = VariantRecord(F.col("fields"))
    parsed = with_record(pairs, output)
    return parsed.withColumns(
        {
            "matched_entity": matched_entity(record, spec),
            "errors": ontology_errors(record, spec),
            "is_valid": schema_valid(record, spec),
        }
    ).drop("fields")


def examples_table(spark: SparkSession, spec: Spec) -> DataFrame:
    """The spec's declared example pairs as rows of JSON text."""
    rows = [(i, json.dumps(e["input"]), json.dumps(e["output"])) for i, e in enumerate(spec.examples)]
    return spark.createDataFrame(rows, "example int, input string, output string")
