"""Record to prompt text, and model text back to a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.json_text import (
    indented_json,
    parse_record,
    parse_texts,
    parse_value,
    spaced_json,
)

# Where a JSON object may sit in a model's text.
FLAT_OBJECT = r"\{[^{}]*\}"
WIDEST_OBJECT = r"(?s)\{.*\}"


def format_fields(raw: Column) -> Column:
    """``key: value`` lines of a JSON object, in key order; strings unquoted, others as JSON.

    Lists and objects are laid out as Python's ``json.dumps`` does. Only records that may hold any
    are parsed for their types.
    """
    nested = F.when(F.rlike(raw, F.lit(r"(?s)^\s*\{.*[\[{]")), parse_record(raw))

    def lines(fields: Column) -> Column:
        def line(entry: Column) -> Column:
            kind = fields[entry["key"]]["type"]
            inner = F.coalesce(F.rlike(kind, F.lit("^(OBJECT|ARRAY)<")), F.lit(False))
            value = F.coalesce(entry["value"], F.lit("null"))
            return F.concat(
                entry["key"], F.lit(": "), F.when(inner, spaced_json(value)).otherwise(value)
            )

        return F.array_join(F.transform(F.map_entries(parse_texts(raw)), line), "\n")

    return F.get(F.transform(F.array(nested), lines), F.lit(0))


def format_input(value: Column, text: Column) -> Column:
    """Prompt text of any JSON value: objects as lines, other values as Python prints them.

    ``value`` is the VARIANT and ``text`` the same value's JSON text, or the string itself.
    """
    type_name = F.schema_of_variant(value)
    return (
        F.when(type_name.startswith("OBJECT<"), format_fields(text))
        .when(type_name == "VOID", F.lit("None"))
        .when(type_name == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def format_output(value: Column, text: Column) -> Column:
    """Compact JSON text of a value, keys in document order."""
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, F.to_json(value)).otherwise(F.coalesce(text, F.lit("null")))


LAYOUTS = {"indented": indented_json, "compact": lambda text: text}


def extract_json(text: Column) -> Column:
    """The JSON value a model meant, as VARIANT; null when there is none.

    The first readable flat object wins, which is the innermost one of a nested object; then
    the widest brace pair, then the whole text. Later forms are read only if earlier ones fail.
    """
    flat = F.filter(
        F.regexp_extract_all(text, F.lit(FLAT_OBJECT), F.lit(0)),
        lambda part: parse_value(part).isNotNull(),
    )
    widest = F.regexp_extract(text, WIDEST_OBJECT, 0)
    return F.coalesce(
        parse_value(F.get(flat, F.lit(0))), parse_value(F.nullif(widest, F.lit(""))), parse_value(text)
    )


def extract_json_text(text: Column) -> Column:
    """As ``extract_json``, but the matched text itself: it keeps the key order."""
    flat = F.filter(
        F.regexp_extract_all(text, F.lit(FLAT_OBJECT), F.lit(0)),
        lambda part: parse_value(part).isNotNull(),
    )
    widest = F.regexp_extract(text, WIDEST_OBJECT, 0)
    return F.coalesce(
        F.get(flat, F.lit(0)),
        F.when(parse_value(widest).isNotNull(), widest),
        F.when(parse_value(text).isNotNull(), text),
    )


def parse_output(text: Column) -> Column:
    """The text as JSON, or ``{"text": ...}`` around it."""
    return F.coalesce(
        parse_value(text), F.to_variant_object(F.struct(text.alias("text")))
    )
