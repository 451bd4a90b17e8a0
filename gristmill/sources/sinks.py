"""Writers: JSONL per split, text lines, the curation summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.split import SPLITS


def write_jsonl(df: DataFrame, path: str, *, by: str | None = "split", mode: str = "errorifexists") -> None:
    """One record per line as it was read, in one folder per split.

    Later readers of a single split open only its folder.
    """
    if by is None:
        df.select(F.col("raw").alias("value")).write.mode(mode).text(path)
    else:
        df.select(F.col("raw").alias("value"), by).write.mode(mode).partitionBy(by).text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """One string per line, replacing what is there."""
    lines.write.mode("overwrite").text(path)


def append_lines(lines: DataFrame, path: str) -> None:
    """One string per line, added to what is there."""
    lines.write.mode("append").text(path)


def curation_summary(
    split_rows: DataFrame, include_tags: Sequence[str] = (), exclude_tags: Sequence[str] = ()
) -> DataFrame:
    """One row: total and per-split counts and the tag arguments."""

    def tags(names: Sequence[str]) -> Column:
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    counts = [F.count_if(F.col("split") == name).alias(f"{name}_samples") for name in SPLITS]
    return split_rows.agg(F.count("*").alias("total_samples"), *counts).select(
        "*", tags(include_tags).alias("include_tags"), tags(exclude_tags).alias("exclude_tags")
    )


def write_summary(summary: DataFrame, source_files: DataFrame, path: str) -> None:
    """The summary as one JSON row, and beside it the list of source files.

    The list grows with the corpus, so it is a table of its own rather than one cell.
    """
    summary.write.mode("overwrite").json(f"{path}/metadata")
    source_files.select(F.col("path").alias("value")).write.mode("overwrite").text(
        f"{path}/source_files"
    )
