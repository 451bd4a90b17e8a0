"""Exact-size, reproducible train/val/test split without moving the rows.

Rows are ordered by a seeded hash of their key. Only the two hashes where the split changes
have to be found; then every row is placed by comparing its own hash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")

# Hash prefixes of four hex digits: at most 65,536 counts, whatever the number of rows.
PREFIX = 4
BEYOND_ALL_HASHES = "g"


def split_hash(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("\x00"))))


def cut_points(hashes: DataFrame, train_ratio: float, val_ratio: float) -> DataFrame:
    """One row ``cut STRUCT<val, test>``: the first hash of the val and of the test rows.

    Counting by prefix tells which prefix holds each cut; only rows with that prefix, one in
    65,536, are then ranked.
    """
    prefix = F.substring("h", 1, PREFIX)
    counts = hashes.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("rows"))
    everything = Window.orderBy("prefix")
    total = F.sum("rows").over(Window.partitionBy())
    train_end = F.floor(total * F.lit(float(train_ratio)))
    val_end = train_end + F.floor(total * F.lit(float(val_ratio)))
    located = (
        counts.select(
            "prefix",
            (F.sum("rows").over(everything) - F.col("rows")).alias("before"),
            F.sum("rows").over(everything).alias("through"),
            F.array(
                F.struct(F.lit("val").alias("cut"), train_end.alias("rank")),
                F.struct(F.lit("test").alias("cut"), val_end.alias("rank")),
            ).alias("cuts"),
        )
        .select("prefix", "before", "through", F.inline("cuts"))
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("through")))
        .select("prefix", "before", "cut", "rank")
    )
    near = (
        hashes.select("h", prefix.alias("prefix"))
        .join(F.broadcast(located), "prefix")
        .groupBy("cut", "before", "rank", "h")
        .agg(F.count("*").alias("rows"))
    )
    through = F.col("before") + F.sum("rows").over(Window.partitionBy("cut").orderBy("h"))
    beyond = near.select("cut", "h", "rank", through.alias("through")).where("through > rank")

    def first_hash(cut: str) -> Column:
        hash_ = F.min(F.when(F.col("cut") == cut, F.col("h")))
        return F.coalesce(hash_, F.lit(BEYOND_ALL_HASHES)).alias(cut)

    return beyond.agg(F.struct(first_hash("val"), first_hash("test")).alias("cut"))


def split_rows(
    df: DataFrame,
    key: Column | str,
    *,
    train_ratio: float = 0.8,
    val_ratio: float = 0.1,
    seed: int = 42,
    keys: DataFrame | None = None,
    cut: Row | None = None,
) -> DataFrame:
    """Add ``split``: int(n * train_ratio) train rows, int(n * val_ratio) val rows, rest test.

    ``key`` must identify a row; rows sharing a key share a split. ``keys`` may give the same
    rows more cheaply than ``df`` for finding the cuts, for instance before a wide join. ``cut``
    gives cuts already found by ``find_cut``; otherwise they are found as part of the query.
    """
    key = F.col(key) if isinstance(key, str) else key
    row_hash = split_hash(key, seed)
    if cut is not None:
        first_val, first_test = F.lit(cut.val), F.lit(cut.test)
    else:
        hashes = (keys if keys is not None else df).select(row_hash.alias("h"))
        found = cut_points(hashes, train_ratio, val_ratio).scalar()
        first_val, first_test = found["val"], found["test"]
    return df.withColumn(
        "split",
        F.when(row_hash < first_val, "train").when(row_hash < first_test, "val").otherwise("test"),
    )


def find_cut(
    df: DataFrame,
    key: Column | str,
    *,
    train_ratio: float = 0.8,
    val_ratio: float = 0.1,
    seed: int = 42,
) -> Row:
    """The two hashes where the split changes, for several queries over the same rows."""
    key = F.col(key) if isinstance(key, str) else key
    hashes = df.select(split_hash(key, seed).alias("h"))
    return cut_points(hashes, train_ratio, val_ratio).first().cut


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))
