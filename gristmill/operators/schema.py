"""Table schemas derived from a spec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.checks import Record, is_entity
from gristmill.spec import Entity, Field, Spec

SPARK_TYPES = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def field_type(field: Field) -> T.DataType:
    if field.json_type == "array":
        return T.ArrayType(SPARK_TYPES[field.item_type])
    return SPARK_TYPES[field.json_type]


def table_schema(entity: Entity) -> T.StructType:
    """Column per field; enum, range, description and default travel as metadata."""
    columns = []
    for field in entity.fields:
        facts = {
            "enum": list(field.enum) if field.enum else None,
            "range": list(field.range) if field.range else None,
            "description": field.description,
            "default": field.default,
        }
        metadata = {name: value for name, value in facts.items() if value is not None}
        columns.append(T.StructField(field.name, field_type(field), not field.required, metadata))
    return T.StructType(columns)


def read_as(raw: Column, entity: Entity) -> Column:
    """JSON text as the entity's struct; values of another type become null."""
    return F.from_json(raw, table_schema(entity))


def as_table(df: DataFrame, entity: Entity) -> DataFrame:
    """Project onto the entity's columns, cast where possible, null where absent."""
    return df.select(
        *[
            (F.col(f.name).try_cast(field_type(f)) if f.name in df.columns
             else F.lit(None).cast(field_type(f))).alias(f.name)
            for f in entity.fields
        ]
    )


def fill_defaults(df: DataFrame, entity: Entity) -> DataFrame:
    """Replace missing values by the field's declared default, where it has one."""
    filled = {
        f.name: F.coalesce(F.col(f.name), F.lit(f.default).cast(field_type(f)))
        for f in entity.fields
        if f.default is not None and f.name in df.columns
    }
    return df.withColumns(filled) if filled else df


def route(df: DataFrame, record: Record, spec: Spec) -> dict[str, DataFrame]:
    """One table per entity, by the record's ``type``."""
    return {name: df.where(is_entity(record, name)) for name in spec.entity_names}
