"""Choosing among a model's answers to one prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _tried(candidates: DataFrame, attempt: str, max_attempts: int | None) -> DataFrame:
    return candidates if max_attempts is None else candidates.where(F.col(attempt) <= max_attempts)


def best_of(
    candidates: DataFrame,
    valid: Column,
    *,
    prompt: str = "prompt_id",
    attempt: str = "attempt",
    text: str = "text",
    max_attempts: int | None = None,
) -> DataFrame:
    """The first valid attempt of each prompt, or its last attempt when none is valid.

    All attempts count unless ``max_attempts`` sets a last one. Every task first reduces its own
    attempts of a prompt to at most two.
    """
    judged = _tried(candidates, attempt, max_attempts).select(
        prompt,
        F.struct(F.col(attempt).alias("attempt"), F.col(text).alias("text")).alias("answer"),
        F.col(attempt).alias("_order"),
        F.coalesce(valid, F.lit(False)).alias("_valid"),
    )
    chosen = judged.groupBy(prompt).agg(
        F.min_by("answer", F.when(F.col("_valid"), F.col("_order"))).alias("first_valid"),
        F.max_by("answer", "_order").alias("last"),
    )
    answer = F.coalesce("first_valid", "last")
    return chosen.select(
        prompt,
        answer["attempt"].alias(attempt),
        answer["text"].alias(text),
        F.col("first_valid").isNotNull().alias("accepted"),
    )


def rejection_log(
    candidates: DataFrame,
    errors: Column,
    *,
    prompt: str = "prompt_id",
    attempt: str = "attempt",
    max_attempts: int | None = None,
) -> DataFrame:
    """One row per error of each rejected attempt, up to ``max_attempts`` if that is set."""
    return _tried(candidates, attempt, max_attempts).select(prompt, attempt, F.inline(errors))
