"""Quality filter over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.checks import Record
from gristmill.functions.quality import (
    QualityConfig,
    extract_score,
    extract_text,
    passes_quality,
    reject_reason,
)
from gristmill.functions.record import VariantRecord


def _extracted(
    df: DataFrame, record: Record, config: QualityConfig
) -> tuple[DataFrame, dict[str, Column]]:
    """Text and score of open records as columns, worked out once per row.

    They come out of a one-row generator, as the optimizer would otherwise repeat the extraction
    for every bound and pattern that mentions them. Typed columns are cheap to mention.
    """
    if not isinstance(record, VariantRecord):
        return df, {}
    wanted = {"text": extract_text(record)}
    if config.min_quality_score is not None:
        wanted["score"] = extract_score(record)
    pair = F.struct(*[column.alias(f"_quality_{name}") for name, column in wanted.items()])
    return df.select("*", F.inline(F.array(pair))), {n: F.col(f"_quality_{n}") for n in wanted}


def filter_quality(df: DataFrame, record: Record, config: QualityConfig) -> DataFrame:
    """Keep the rows that satisfy every condition."""
    rows, extracted = _extracted(df, record, config)
    return rows.where(passes_quality(record, config, **extracted)).drop("_quality_text", "_quality_score")


def filter_rows(df: DataFrame, predicate: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Keep the rows a user predicate accepts: a Column, which may call a pandas UDF."""
    condition = predicate(df) if callable(predicate) else predicate
    return df.where(F.coalesce(condition, F.lit(False)))


def reject_reasons(df: DataFrame, record: Record, config: QualityConfig) -> DataFrame:
    """How many rows each condition rejects, counting only a row's first failure."""
    rows, extracted = _extracted(df, record, config)
    reasons = rows.select(reject_reason(record, config, **extracted).alias("reason"))
    return reasons.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
