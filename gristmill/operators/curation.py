"""Tag filter and exact deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.checks import Record, any_of
from gristmill.functions.json_text import canonical
from gristmill.functions.record import TypedRecord, VariantRecord, is_true
from gristmill.functions.text import KEYWORD_TAGS, has_any_keyword, keyword_tags, normalize_text

# Keys that do not decide whether two records are copies.
VOLATILE_KEYS = ("id", "created_at", "updated_at", "source", "filename")


# --- tags ------------------------------------------------------------------------------


def _no_tags() -> Column:
    return F.array().cast("array<string>")


def _variant_tags(value: Column) -> Column:
    """Tags of a list or a comma string; nothing for other values, no trimming."""
    type_name = F.schema_of_variant(value)
    listed = F.transform(
        F.filter(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda v: F.schema_of_variant(v) == "STRING",
        ),
        lambda v: F.try_variant_get(v, "$", "string"),
    )
    comma = F.when(
        type_name == "STRING",
        F.split(F.try_variant_get(value, "$", "string"), ",", -1),
    )
    return F.coalesce(listed, comma, _no_tags())


def _typed_tags(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        return F.coalesce(column, _no_tags())
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.split(column, ",", -1), _no_tags())
    return _no_tags()


def declared_tags(record: Record) -> list[Column]:
    """Tag arrays the record states itself: ``tags`` and ``metadata.tags``."""
    if isinstance(record, VariantRecord):
        raw = record.value("metadata").raw
        return [
            _variant_tags(record.value("tags").raw),
            _variant_tags(F.try_variant_get(raw, "$.tags", "variant")),
        ]
    found = []
    if "tags" in record.columns:
        found.append(_typed_tags(F.col(record.columns["tags"]), record.types["tags"]))
    metadata = record.types.get("metadata")
    if isinstance(metadata, T.StructType) and "tags" in metadata.fieldNames():
        inner = F.col(record.columns["metadata"])["tags"]
        found.append(_typed_tags(inner, metadata["tags"].dataType))
    return found


def tags_of(record: Record) -> Column:
    """All tags of a record: declared ones and keywords found in its text."""
    text = F.coalesce(keyword_tags(record.value("text").text), _no_tags())
    return F.array_distinct(F.concat(*declared_tags(record), text))


def has_any_tag(record: Record, tags: Sequence[str]) -> Column:
    """True where the record has one of the tags.

    Only the tags asked for are looked up; the text is searched only for those that are
    keywords.
    """
    wanted = F.array(*[F.lit(t) for t in tags])
    declared = [is_true(F.arrays_overlap(found, wanted)) for found in declared_tags(record)]
    text = record.value("text").text
    keywords = [word for word in tags if word in KEYWORD_TAGS]
    return any_of([*declared, *([has_any_keyword(text, keywords)] if keywords else [])])


def tag_list(argument: str | Sequence[str] | None) -> list[str]:
    """Tags given as a comma string or a list. Empty names are dropped, so "" means none."""
    names = argument.split(",") if isinstance(argument, str) else list(argument or [])
    return [name for name in names if name]


def filter_tags(
    df: DataFrame,
    record: Record,
    include: str | Sequence[str] | None = None,
    exclude: str | Sequence[str] | None = None,
    *,
    or_else: Column | None = None,
) -> DataFrame:
    """Keep rows with an included and without an excluded tag; an empty list restricts nothing.

    Rows for which ``or_else`` holds are kept whatever their tags.
    """
    also = F.lit(False) if or_else is None else or_else
    if wanted := tag_list(include):
        df = df.where(also | has_any_tag(record, wanted))
    if unwanted := tag_list(exclude):
        df = df.where(also | ~has_any_tag(record, unwanted))
    return df


# --- duplicates ------------------------------------------------------------------------


def normalized_fields(fields: Column) -> Column:
    """A record without the keys that do not count, and without its text if that is a string."""
    return F.map_filter(
        fields,
        lambda key, value: ~key.isin(*VOLATILE_KEYS)
        & ~((key == "text") & (value["type"] == "STRING")),
    )


def record_hash(fields: Column) -> Column:
    """md5 that is equal exactly for records that are copies of each other."""
    text = VariantRecord(fields).value("text")
    return F.md5(
        F.concat(
            canonical(normalized_fields(fields)),
            F.coalesce(F.concat(F.lit("\n"), normalize_text(text.text)), F.lit("")),
        )
    )


def row_hash(record: TypedRecord) -> Column:
    """md5 of typed columns; of the normalised text alone where that is the only one."""
    names = sorted(name for name in record.columns if name not in VOLATILE_KEYS)
    parts = [
        normalize_text(F.col(record.columns[n])) if n == "text" else F.col(record.columns[n])
        for n in names
    ]
    if names == ["text"]:
        return F.md5(parts[0])
    return F.md5(
        F.to_json(
            F.struct(*[part.alias(name) for part, name in zip(parts, names, strict=True)]),
            {"ignoreNullFields": "false"},
        )
    )


def first_keys(df: DataFrame, copies_of: Column, key: str) -> DataFrame:
    """Keys of the first row of every group of copies; ``key`` is unique and gives the order.

    Only hash and key travel, pre-aggregated per task, so a group holding much of the table
    costs its reducer one small row per task.
    """
    narrow = df.select(F.unhex(copies_of).alias("copies_of"), key)
    return narrow.groupBy("copies_of").agg(F.min(key).alias(key)).select(key)


def drop_copies(df: DataFrame, copies_of: Column, key: str) -> DataFrame:
    """Keep the first row of every group of copies, for rows with a unique ordering key.

    Whole rows meet the surviving keys on the key itself, which no group can skew.
    """
    return df.join(first_keys(df, copies_of, key), key, "left_semi")


def drop_copies_in_table(df: DataFrame, copies_of: Column, order: Sequence[str]) -> DataFrame:
    """As ``drop_copies`` for rows identified by several columns, in their order.

    The first row of a group is found on hash and position alone; whole rows move once.
    """
    place = F.struct(*order).alias("_first")
    first = df.select(copies_of.alias("_copies_of"), place).groupBy("_copies_of").agg(
        F.min("_first").alias("_first")
    )
    return df.join(first.select("_first.*"), list(order), "left_semi")


def drop_copies_in_scan(df: DataFrame, copies_of: Column, order: Sequence[str]) -> DataFrame:
    """As ``drop_copies`` for file scans, whose records have an address that every pass agrees on.

    Only hash and address are grouped, so large groups stay small; whole records of a second pass meet the
    addresses of first copies.
    """
    return drop_copies_in_table(df, copies_of, order)
