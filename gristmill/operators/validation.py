"""Violation tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.checks import Record, constraint_holds
from gristmill.spec import Constraint


def violations(df: DataFrame, errors: Column, keep: Sequence[str]) -> DataFrame:
    """One row per error, with the columns to keep."""
    return df.select(*keep, F.inline(errors))


def violations_by_rule(df: DataFrame, errors: Column) -> DataFrame:
    """Number of errors per rule, entity and field."""
    found = df.select(F.inline(errors)).select("rule", "entity", "field")
    return found.groupBy("rule", "entity", "field").agg(F.count("*").alias("n"))


def constraint_violations(
    df: DataFrame, record: Record, constraints: Iterable[Constraint], keep: Sequence[str]
) -> DataFrame:
    """One row per broken constraint, with its declared severity and message."""
    broken = [
        F.when(
            ~constraint_holds(record, c),
            F.struct(
                F.lit(c.expr).alias("constraint"),
                F.lit(c.severity).alias("severity"),
                F.lit(c.message).cast("string").alias("message"),
            ),
        )
        for c in constraints
    ]
    return df.select(*keep, F.inline(F.array_compact(F.array(*broken))))


BatchCheck = Callable[[Sequence[Mapping[str, Any]]], Sequence[bool]]


def python_validator(check: BatchCheck) -> Callable[[Column], Column]:
    """A Python check of a batch of records as a Column over their JSON text.

    Gives ``STRUCT<ok, problem>``. Where the check of a batch raises, its records are checked one
    by one, so that only those it fails on have no answer (``ok`` is null) and the reason in
    ``problem``.
    """

    def answer(records: list) -> list[tuple]:
        try:
            return [(bool(ok), None) for ok in check(records)]
        except Exception as error:
            if len(records) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            return [row for record in records for row in answer([record])]

    @F.pandas_udf("ok boolean, problem string")
    def judged(texts: pd.Series) -> pd.DataFrame:
        records, unread = [], {}
        for place, text in enumerate(texts):
            try:
                records.append(json.loads(text))
            except (TypeError, ValueError) as error:
                unread[place] = (None, f"{type(error).__name__}: {error}")
        rows = iter(answer(records) if records else ())
        return pd.DataFrame(
            [unread[i] if i in unread else next(rows) for i in range(len(texts))],
            columns=["ok", "problem"],
        ).astype({"ok": "boolean", "problem": "object"})

    return judged
