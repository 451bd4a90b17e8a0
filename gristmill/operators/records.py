"""Parsing text columns into records, once per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.json_text import parse_record


def with_record(
    df: DataFrame, raw: Column | str = "raw", name: str = "fields", keep: Sequence[str] = ("*",)
) -> DataFrame:
    """Add the parsed record of a JSON text column; null where the text holds no object.

    The column comes out of a generator with one row in and one row out. A plain projection
    would let the optimizer move a later filter below it and repeat the parse at every place
    where the filter mentions the record; filters on other columns still move down.
    """
    text = F.col(raw) if isinstance(raw, str) else raw
    return df.select(*keep, F.inline_outer(F.array(F.struct(parse_record(text).alias(name)))))
