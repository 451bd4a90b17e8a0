"""Many patterns at once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import is_plain, java_expression, matches, required_literal
from gristmill.session import ship_package


def with_patterns_found(df: DataFrame, text: Column, patterns: Sequence[str], name: str = "found") -> DataFrame:
    """Add ``name``: the ascending positions (from 0) of the patterns that the text contains.

    Equal to ``matches`` on each pattern, at a cost that hardly depends on their number. One automaton reads
    the text once and tells which of the patterns' required literals occur in it, overlapping ones too. A
    pattern that is a literal is decided by that; an expression runs only on texts that contain its
    literal. Expressions without one run on every text, as they do in ``matches``. A null text has
    none. Repeated patterns are all reported.
    """
    if not patterns:
        return df.withColumn(name, F.array().cast("array<int>"))
    literals: dict[str, list[int]] = {}
    always: list[int] = []
    for i, pattern in enumerate(patterns):
        literal = required_literal(pattern)
        literals.setdefault(literal, []).append(i) if literal else always.append(i)
    plain = {i for i, pattern in enumerate(patterns) if is_plain(pattern)}
    # Refused here, on the driver, if a pattern cannot be carried over.
    expressions = [None if i in plain else java_expression(pattern) for i, pattern in enumerate(patterns)]

    parts = [F.when(matches(text, patterns[i]), F.lit(i)) for i in always]
    found = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<int>")
    if literals:
        ship_package(df.sparkSession)
        near = F.pandas_udf(_finder(literals), "array<int>")(text)
        # One literal, folded when the query is planned.
        table = F.from_json(F.lit(json.dumps(expressions)), "array<string>")

        def holds(i: Column) -> Column:
            expression = F.element_at(table, i + 1)
            return expression.isNull() | F.rlike(text, expression)

        found = F.concat(found, F.filter(near, holds))
    return df.withColumn(name, F.array_sort(F.coalesce(found, F.array().cast("array<int>"))))


def _finder(literals: dict[str, list[int]]) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """For each text, the patterns whose literal occurs in it."""

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for literal, users in literals.items():
            automaton.add_word(literal, users)
        automaton.make_automaton()

        def one(text: str | None) -> list[int]:
            if text is None:
                return []
            hits = {id(users): users for _, users in automaton.iter(text)}
            return [i for users in hits.values() for i in users]

        for part in texts:
            yield part.map(one)

    find.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return find
