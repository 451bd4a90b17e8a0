"""One view of a record for all checks, whether its columns are typed or its keys open.

``VariantRecord`` reads a parsed record, a map of VARIANT values; ``TypedRecord`` reads ordinary columns.
Every boolean Column here is true or false, never null, so checks can be combined freely.
On typed columns most of them are literals that the optimizer folds away.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.json_text import is_integer_type, python_text


def true() -> Column:
    return F.lit(True)


def false() -> Column:
    return F.lit(False)


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


class Value:
    """What the checks need to know about the value of one key.

    ``text`` is the string, null for other values; ``number`` the number, booleans as 0 and 1,
    null for other values; ``display`` the value as Python would print it.
    """

    raw: Column
    present: Column
    is_null: Column
    is_text: Column
    is_int: Column
    is_float: Column
    is_bool: Column
    is_list: Column
    text: Column
    number: Column
    display: Column

    @cached_property
    def is_numeric(self) -> Column:
        """What Python's int and float cover; a bool is an int there."""
        return self.is_int | self.is_float | self.is_bool

    @property
    def is_nan(self) -> Column:
        """JSON numbers are never NaN."""
        return false()

    def bound(self, limit: float) -> Column:
        return F.lit(limit)

    def items_are(self, json_type: str) -> Column:
        raise NotImplementedError


class _VariantValue(Value):
    def __init__(self, fields: Column, name: str):
        self.present = is_true(F.map_contains_key(fields, F.lit(name)))
        entry = F.element_at(fields, F.lit(name))
        self.raw = entry["value"]
        self.type_name = entry["type"]

    @cached_property
    def is_null(self) -> Column:
        return is_true(self.type_name == "VOID")

    @cached_property
    def is_text(self) -> Column:
        return is_true(self.type_name == "STRING")

    @cached_property
    def is_int(self) -> Column:
        return is_true(is_integer_type(self.type_name))

    @cached_property
    def is_float(self) -> Column:
        broken = (self.type_name == "DOUBLE") | self.type_name.startswith("DECIMAL(")
        return is_true(broken) & ~self.is_int

    @cached_property
    def is_bool(self) -> Column:
        return is_true(self.type_name == "BOOLEAN")

    @cached_property
    def is_list(self) -> Column:
        return is_true(self.type_name.startswith("ARRAY<"))

    @cached_property
    def text(self) -> Column:
        return F.when(self.is_text, F.try_variant_get(self.raw, "$", "string"))

    @cached_property
    def number(self) -> Column:
        return F.when(~self.is_text, F.try_variant_get(self.raw, "$", "double"))

    @cached_property
    def display(self) -> Column:
        return python_text(self.raw)

    def items_are(self, json_type: str) -> Column:
        items = F.try_variant_get(self.raw, "$", "array<variant>")
        return is_true(F.forall(items, lambda item: _item_is(item, json_type)))


def _item_is(item: Column, json_type: str) -> Column:
    name = F.schema_of_variant(item)
    if json_type == "string":
        return name == "STRING"
    if json_type == "boolean":
        return name == "BOOLEAN"
    is_float = (name == "DOUBLE") | (name == "FLOAT") | name.startswith("DECIMAL(")
    if json_type == "integer":
        number = F.try_variant_get(item, "$", "double")
        return (name == "BIGINT") | (is_float & (number == F.floor(number)))
    return (name == "BIGINT") | is_float


class VariantRecord:
    """A record with open keys. ``fields`` is null where the row holds no object."""

    def __init__(self, fields: Column):
        self.fields = fields
        self._values: dict[str, Value] = {}

    @property
    def is_object(self) -> Column:
        return self.fields.isNotNull()

    @property
    def keys(self) -> Column:
        return F.coalesce(F.map_keys(self.fields), F.array().cast("array<string>"))

    def value(self, name: str) -> Value:
        if name not in self._values:
            self._values[name] = _VariantValue(self.fields, name)
        return self._values[name]

    def unknown_keys(self, known: list[str]) -> Column:
        names = F.array(*[F.lit(name) for name in known]).cast("array<string>")
        return F.array_except(self.keys, names)

    def has_unknown_keys(self, known: list[str]) -> Column:
        return F.size(self.unknown_keys(known)) > 0

    def strings(self) -> Column:
        """All string values in key order, as an array."""
        texts = F.filter(F.map_values(self.fields), lambda v: v["type"] == "STRING")
        return F.transform(texts, lambda v: F.try_variant_get(v["value"], "$", "string"))


class _FlatValue(_VariantValue):
    """A value whose type, text and number were taken out of the map once per row."""

    def __init__(self, entry: Column):
        self.present = entry["present"]
        self.type_name = entry["type"]
        self.raw = entry["value"]
        self.text = entry["text"]
        self.number = entry["number"]


class FlatRecord(VariantRecord):
    """A record with open keys, some of which were looked up beforehand by ``look_up``."""

    def __init__(self, fields: Column, looked_up: Mapping[str, Column]):
        super().__init__(fields)
        self._values = {name: _FlatValue(entry) for name, entry in looked_up.items()}


LOOKED_UP = "_looked_up"


def look_up(df: DataFrame, record: VariantRecord, names: Iterable[str]) -> tuple[DataFrame, FlatRecord]:
    """Look the given keys up once per row; drop the column ``LOOKED_UP`` when done.

    Checks mention a key many times, and a look-up in the map is interpreted each time, while the
    members of a struct are read by compiled code. The struct comes out of a one-row generator, as
    the optimizer would otherwise put the look-ups back into every mention.
    """
    entries = {}
    for i, name in enumerate(dict.fromkeys(names)):
        value = _VariantValue(record.fields, name)
        entries[name] = F.struct(
            value.present.alias("present"), value.type_name.alias("type"), value.raw.alias("value"),
            value.text.alias("text"), value.number.alias("number"),
        ).alias(f"k{i}")
    if not entries:
        return df, FlatRecord(record.fields, {})
    row = F.struct(F.struct(*entries.values()).alias(LOOKED_UP))
    found = {name: F.col(LOOKED_UP)[f"k{i}"] for i, name in enumerate(entries)}
    return df.select("*", F.inline(F.array(row))), FlatRecord(record.fields, found)


def _kind(dtype: T.DataType | None) -> str:
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.ArrayType):
        return "list"
    return "other"


class _TypedValue(Value):
    """``dtype`` is None for a key the table does not have."""

    def __init__(self, column: str | None, dtype: T.DataType | None):
        self.dtype = dtype
        self.kind = _kind(dtype)
        self.present = F.lit(dtype is not None)
        self.raw = F.col(column) if column is not None else F.lit(None)
        self.is_null = self.raw.isNull() if dtype is not None else false()

    def _holds(self, kind: str) -> Column:
        return self.raw.isNotNull() if self.kind == kind else false()

    @cached_property
    def is_text(self) -> Column:
        return self._holds("text")

    @cached_property
    def is_int(self) -> Column:
        return self._holds("int")

    @cached_property
    def is_float(self) -> Column:
        return self._holds("float")

    @cached_property
    def is_bool(self) -> Column:
        return self._holds("bool")

    @cached_property
    def is_list(self) -> Column:
        return self._holds("list")

    @cached_property
    def text(self) -> Column:
        return self.raw if self.kind == "text" else F.lit(None).cast("string")

    @cached_property
    def number(self) -> Column:
        if self.kind == "bool":
            return self.raw.cast("int")
        return self.raw if self.kind in ("int", "float") else F.lit(None).cast("double")

    @cached_property
    def display(self) -> Column:
        if self.dtype is None:
            return F.lit(None).cast("string")
        if self.kind == "bool":
            shown = F.initcap(self.raw.cast("string"))
        elif self.kind == "list":
            shown = F.to_json(self.raw)
        else:
            shown = self.raw.cast("string")
        return F.coalesce(shown, F.lit("None"))

    @property
    def is_nan(self) -> Column:
        if isinstance(self.dtype, (T.FloatType, T.DoubleType)):
            return is_true(F.isnan(self.raw))
        return false()

    def bound(self, limit: float) -> Column:
        """Whole bounds stay integers on integer columns: exact, and without casts."""
        if self.kind == "int" and float(limit).is_integer():
            return F.lit(int(limit))
        return F.lit(limit)

    def items_are(self, json_type: str) -> Column:
        if self.kind != "list":
            return false()
        kind = _kind(self.dtype.elementType)
        fits = {"string": ("text",), "boolean": ("bool",)}.get(json_type, ("int", "float"))
        if kind not in fits:
            return is_true(F.size(self.raw) == 0)
        if json_type == "integer" and kind == "float":
            return is_true(F.forall(self.raw, lambda x: is_true(x == F.floor(x))))
        return is_true(F.forall(self.raw, lambda x: x.isNotNull()))


class TypedRecord:
    """A record whose keys are columns; a null cell is a key present with a null value.

    ``columns`` maps record keys to column names. By default every column is a key.
    """

    def __init__(self, df: DataFrame, columns: Mapping[str, str] | list[str] | None = None):
        if columns is None:
            columns = df.columns
        if not isinstance(columns, Mapping):
            columns = {name: name for name in columns}
        schema = df.schema
        self.columns = dict(columns)
        self.types = {key: schema[name].dataType for key, name in self.columns.items()}
        self._values: dict[str, Value] = {}

    @property
    def is_object(self) -> Column:
        return true()

    @property
    def keys(self) -> Column:
        return F.array(*[F.lit(name) for name in self.columns]).cast("array<string>")

    def value(self, name: str) -> Value:
        if name not in self._values:
            self._values[name] = _TypedValue(self.columns.get(name), self.types.get(name))
        return self._values[name]

    def unknown_keys(self, known: list[str]) -> Column:
        extra = [F.lit(name) for name in self.columns if name not in known]
        return F.array(*extra).cast("array<string>")

    def has_unknown_keys(self, known: list[str]) -> Column:
        return F.lit(any(name not in known for name in self.columns))

    def strings(self) -> Column:
        texts = [F.col(c) for k, c in self.columns.items() if _kind(self.types[k]) == "text"]
        return F.array_compact(F.array(*texts).cast("array<string>"))
