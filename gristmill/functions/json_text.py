"""JSON text to VARIANT values and open-keyed records, with Python's strictness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's parser refuses single quotes; NaN and Infinity have no VARIANT form.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# Put behind a text to see whether the parser reached its end.
MARK = "gristmill:end"

# A record: its keys in document order, each value with the name of its type. Checks ask for the
# type many times, so it is worked out once, when the text is parsed.
RECORD_TYPE = "map<string,struct<value:variant,type:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ends_cleanly(text: Column) -> Column:
    """False where something follows the value.

    Spark's parser stops after the first value. The parses below put the text into an array
    with a mark behind it, so whatever follows the value moves or hides the mark. Only a text
    holding the mark itself, as it is or spelled with escapes, could still get by; it is parsed
    again inside an object, where a mark has to be followed by a colon and not by a comma.
    """
    unmarked = ~F.contains(text, F.lit(MARK)) & ~F.contains(text, F.lit("\\u"))
    return unmarked | F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()


def parse_value(text: Column) -> Column:
    """Any JSON value as VARIANT; null when the text is not exactly one JSON value."""
    return _once(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{MARK}"]'))),
        lambda items: F.when(
            (F.try_variant_get(items, "$[1]", "string") == MARK) & _ends_cleanly(text),
            F.try_variant_get(items, "$[0]", "variant"),
        ),
    )


def last_wins(fields: Column) -> Column:
    """Keep the last value of a repeated key, at the key's first position."""
    keys = F.map_keys(fields)
    distinct = F.array_distinct(keys)
    rebuilt = F.map_from_arrays(
        distinct,
        F.transform(
            distinct,
            lambda k: F.element_at(F.map_values(F.map_filter(fields, lambda k2, _: k2 == k)), -1),
        ),
    )
    return F.when(F.size(distinct) == F.size(keys), fields).otherwise(rebuilt)


def parse_record(text: Column) -> Column:
    """A JSON object as a record in document order; null for anything else.

    The map keeps what a struct would lose: absent and null keys differ, and unknown keys stay.
    """
    return _parse_object(text, "map<string,variant>", typed)


def typed(values: Column) -> Column:
    """``MAP<STRING,VARIANT>`` as a record."""
    return F.transform_values(
        values,
        lambda _, v: F.struct(v.alias("value"), F.schema_of_variant(v).alias("type")),
    )


def as_record(value: Column) -> Column:
    """A VARIANT object as a record; null for other values."""
    is_object = F.schema_of_variant(value).startswith("OBJECT<")
    return F.when(is_object, typed(F.try_variant_get(value, "$", "map<string,variant>")))


def parse_texts(text: Column) -> Column:
    """A JSON object as ``MAP<STRING,STRING>``: strings as they are, other values as JSON text.

    Nested values keep their key order, which a VARIANT does not, and floats their ``.0``.
    """
    return _parse_object(text, "map<string,string>")


def _parse_object(
    text: Column, object_type: str, finish: Callable[[Column], Column] = lambda fields: fields
) -> Column:
    return _once(
        F.from_json(
            F.concat(F.lit("["), text, F.lit(f',{{"{MARK}":0}}]')), f"array<{object_type}>", STRICT
        ),
        lambda items: F.when(
            F.map_contains_key(F.get(items, F.lit(1)), F.lit(MARK)) & _ends_cleanly(text),
            finish(last_wins(F.get(items, F.lit(0)))),
        ),
    )


def parse_records(text: Column) -> Column:
    """A JSON array of objects as ``ARRAY<STRUCT<raw,fields>>``; null for anything else.

    ``raw`` is the element's own text. The two parses wrap the text differently, so a text that
    closes one wrapper early fails in the other.
    """
    raws = F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("}")), "struct<v:array<string>>", STRICT
    )["v"]
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    arrays = F.from_json(wrapped, "array<array<map<string,variant>>>", STRICT)
    pairs = _once(
        arrays,
        lambda a: F.when(
            (F.size(a) == 1) & ~F.exists(F.get(a, F.lit(0)), lambda m: m.isNull()),
            F.zip_with(
                raws,
                F.get(a, F.lit(0)),
                lambda raw, m: F.struct(raw.alias("raw"), typed(last_wins(m)).alias("fields")),
            ),
        ),
    )
    return _once(
        pairs, lambda p: F.when(~F.exists(p, lambda x: x["raw"].isNull()), p)
    )


def is_integer_type(type_name: Column) -> Column:
    """Integers are BIGINT, or beyond 64 bits a DECIMAL of 19 or more digits and no fraction."""
    return (type_name == "BIGINT") | F.coalesce(
        type_name.startswith("DECIMAL(") & type_name.endswith(",0)") & (F.length(type_name) == 13)
        & (type_name >= "DECIMAL(19,0)"),
        F.lit(False),
    )


def value_text(value: Column) -> Column:
    """JSON text of one VARIANT, with the ``.0`` Python keeps on whole floats."""
    type_name = F.schema_of_variant(value)
    whole_float = (
        type_name.startswith("DECIMAL(") & type_name.endswith(",0)") & ~is_integer_type(type_name)
    )
    return F.concat(
        F.to_json(value), F.when(whole_float, F.lit(".0")).otherwise(F.lit(""))
    )


# A string, or what lies between strings and separators. Possessive repeats do not recurse.
JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'
BEFORE_SEPARATOR = rf'\G((?:{JSON_STRING}|[^",:]++)*+)([,:])'
JSON_TOKEN = rf'{JSON_STRING}|[\[\]{{}},:]|[^\[\]{{}},:"\s]++'


def _escaped(char: Column) -> Column:
    """The \\u escape of a character beyond ASCII, a pair of them beyond 16 bits."""
    code = F.ascii(char)

    def unit(number: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(number), 4, "0")))

    above = code - 0x10000
    pair = F.concat(
        unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
    )
    return F.when(code > 0xFFFF, pair).otherwise(unit(code))


def ascii_json(text: Column) -> Column:
    """JSON text with everything beyond visible ASCII escaped, in Python's lower-case spelling."""
    plain = text
    for letter in "ABCDEF":
        # Spark's escapes are in upper case; an even number of backslashes in front is text.
        escape = rf"(?<=(?<!\\)(?:\\\\){{0,99}}\\u[0-9A-Fa-f]{{0,3}}){letter}"
        plain = F.regexp_replace(plain, escape, letter.lower())
    plain = F.when(F.rlike(text, F.lit(r"\\u[0-9a-f]{0,3}[A-F]")), plain).otherwise(text)
    chars = F.transform(
        F.split(plain, ""),
        lambda c: F.when((c == "") | c.between(" ", "~"), c).otherwise(_escaped(c)),
    )
    return F.when(F.rlike(text, F.lit("[^ -~]")), F.array_join(chars, "")).otherwise(plain)


def spaced_json(text: Column) -> Column:
    """Compact JSON text as Python writes it: a blank behind separators, ASCII only."""
    return F.regexp_replace(ascii_json(text), BEFORE_SEPARATOR, "$1$2 ")


def indented_json(text: Column) -> Column:
    """JSON text in Python's two-space layout, ASCII only."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("last"), F.lit("").alias("text"))

    def line(depth: Column) -> Column:
        return F.concat(F.lit("\n"), F.call_function("repeat", F.lit("  "), depth))

    def add(done: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        first = done["last"].isin("{", "[")
        depth = done["depth"] - closes.cast("int")
        piece = (
            F.when(token == ":", F.lit(": "))
            .when(token == ",", token)
            .when(F.when(closes, ~first).otherwise(first | (done["last"] == ",")), F.concat(line(depth), token))
            .otherwise(token)
        )
        return F.struct(
            (depth + opens.cast("int")).alias("depth"), token.alias("last"),
            F.concat(done["text"], piece).alias("text"),
        )

    tokens = F.regexp_extract_all(ascii_json(text), F.lit(JSON_TOKEN), F.lit(0))
    return F.reduce(tokens, start, add)["text"]


def python_text(value: Column) -> Column:
    """Python's str() of a JSON scalar; lists and objects stay JSON text."""
    type_name = F.schema_of_variant(value)
    return (
        F.when(type_name == "STRING", F.try_variant_get(value, "$", "string"))
        .when(type_name == "VOID", F.lit("None"))
        .when(type_name == "BOOLEAN", F.initcap(F.to_json(value)))
        .otherwise(value_text(value))
    )


def canonical(fields: Column) -> Column:
    """A text that is equal exactly for records equal as JSON values.

    Keys are sorted at every level; each value's type is appended because ``1`` and ``1.0``
    print alike.
    """
    keys = F.sort_array(F.map_keys(fields))
    return F.concat(
        F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: fields[k]["value"]))),
        F.to_json(F.transform(keys, lambda k: fields[k]["type"])),
    )
