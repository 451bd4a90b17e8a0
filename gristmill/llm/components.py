"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import staged


def _nearest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges in both directions, and for each node the smallest of itself and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both, both.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """For each node of some edges ``u, v`` (longs) the smallest node it is connected with.

    Large-star and small-star steps alternate: every neighbour above a node, then every one below
    it, is hung on the smallest node in sight, until nothing moves. Returns ``u, v`` with ``v`` the
    smallest node of the component, one row per node but the smallest itself.
    """
    higher = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = staged(higher.distinct(), "edges")
    state = _state(now)
    while True:
        both, least = _nearest(now)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        hung = large.join(least, "u")
        small = (
            hung.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(hung.select("u", F.col("least").alias("v")))
            .distinct()
        )
        now = staged(small, "edges")
        before, state = state, _state(now)
        if state == before:
            return now
