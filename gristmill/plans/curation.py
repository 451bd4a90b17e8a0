"""Curation from end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.record import TypedRecord, VariantRecord
from gristmill.operators.curation import (
    drop_copies_in_table,
    filter_tags,
    first_keys,
    record_hash,
    row_hash,
)
from gristmill.operators.seen import SeenIndex, new_keys
from gristmill.operators.split import find_cut, split_rows
from gristmill.session import configure, free_scratch, scratch_path
from gristmill.sources.files import CORPUS_PATTERNS, SCAN_ORDER, find_files, locate, scan_corpus
from gristmill.sources.sinks import curation_summary, write_jsonl, write_summary


def curate_table(
    df: DataFrame,
    key: str,
    *,
    columns: Mapping[str, str] | Sequence[str] = ("text",),
    include: str | Sequence[str] | None = None,
    exclude: str | Sequence[str] | None = None,
    copies_of: Column | None = None,
    train_ratio: float = 0.8,
    val_ratio: float = 0.1,
    seed: int = 42,
    seen: SeenIndex | None = None,
    run: str | None = None,
) -> DataFrame:
    """Tag filter, exact deduplication and split of a table with a unique key.

    ``columns`` are the ones that make up the record. Survivors and cut points are found on
    keys and hashes alone; whole rows move once, to meet the surviving keys. With an index of ``seen``
    hashes, copies of what earlier runs kept go as well, and this ``run`` is added to it.
    """
    if (seen is None) != (run is None):
        raise ValueError("an index of seen hashes needs the name of this run, and the other way round")
    names = columns if isinstance(columns, Mapping) else list(columns)
    record = TypedRecord(df, names)
    kept = filter_tags(df, record, include, exclude)
    digest = copies_of if copies_of is not None else row_hash(record)
    survivors = first_keys(kept, digest, key) if seen is None else new_keys(kept, digest, key, seen, run)
    unique = kept.join(survivors, key, "left_semi")
    return split_rows(
        unique, key, train_ratio=train_ratio, val_ratio=val_ratio, seed=seed, keys=survivors
    )


def curate_corpus(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    *,
    include: str | Sequence[str] | None = None,
    exclude: str | Sequence[str] | None = None,
    train_ratio: float = 0.8,
    val_ratio: float = 0.1,
    seed: int = 42,
    patterns: Mapping[str, str] | None = None,
    recursive: bool = False,
    on_bad: str = "fail",
) -> DataFrame:
    """Curate a folder of JSON, JSONL and YAML files into JSONL per split, and a summary.

    The corpus is scanned and parsed once, in either mode: readable and unreadable records go to
    a table in the shared folder, with their position and hash. First copies and cuts are found
    there on hashes and positions alone, and whole records move once, to be written. Neither this
    nor a retry after lost executors reads the corpus again. The table is deleted at the end.
    """
    configure(spark)
    scan = scan_corpus(spark, raw_dir, patterns=patterns, recursive=recursive, on_bad=on_bad)
    readable = F.col("fields").isNotNull()
    kept = filter_tags(scan, VariantRecord(F.col("fields")), include, exclude, or_else=~readable)
    stage = scratch_path(spark, "curated")
    kept.select(
        "raw", record_hash(F.col("fields")).alias("hash"), *SCAN_ORDER, readable.cast("int").alias("readable")
    ).write.partitionBy("readable").parquet(stage)
    staged = spark.read.parquet(stage)
    if on_bad == "quarantine":
        bad = staged.where("readable = 0").select(F.col("raw").alias("value"))
        bad.write.mode("overwrite").text(f"{out_dir}/quarantine")

    records = staged.where("readable = 1").drop("readable")
    hashes = records.select("hash").distinct()
    cut = find_cut(hashes, "hash", train_ratio=train_ratio, val_ratio=val_ratio, seed=seed)
    unique = drop_copies_in_table(records, F.col("hash"), SCAN_ORDER)
    write_jsonl(split_rows(unique, "hash", seed=seed, cut=cut), f"{out_dir}/data", mode="overwrite")

    rows = split_rows(hashes, "hash", seed=seed, cut=cut)
    summary = curation_summary(
        rows.select("split"), _tag_names(include), _tag_names(exclude)
    )
    listings = [
        find_files(spark, *locate(raw_dir, pattern), recursive=recursive)
        for pattern in (patterns or CORPUS_PATTERNS).values()
    ]
    write_summary(summary, reduce(DataFrame.unionByName, listings), out_dir)
    free_scratch(spark, stage)
    return spark.read.schema(summary.schema).json(f"{out_dir}/metadata")


def _tag_names(argument: str | Sequence[str] | None) -> list[str]:
    return argument.split(",") if isinstance(argument, str) else list(argument or [])
