"""Work over several runs: what one run keeps, the next ones know."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.catalog.registry import NORMAL_TEXT, query, table
from gristmill.functions.text import normalize_text
from gristmill.operators.seen import SeenIndex, drop_seen
from gristmill.plans.curation import curate_table
from gristmill.session import scratch_path

RUNS = 3


def batches(spark, sf_dir) -> list[DataFrame]:
    documents = table(spark, sf_dir, "documents")
    return [documents.where(F.pmod("doc_id", F.lit(RUNS)) == run) for run in range(RUNS)]


@query(
    f"""SELECT doc_id, doc_id % {RUNS} AS run, md5({NORMAL_TEXT}) AS text_hash FROM documents
        QUALIFY row_number() OVER (PARTITION BY md5({NORMAL_TEXT}) ORDER BY doc_id % {RUNS}, doc_id) = 1"""
)
def d3_across_runs(spark, sf_dir):
    """The documents in three batches; together they keep what one pass over all would keep."""
    index = SeenIndex(spark, scratch_path(spark, "seen"), buckets=8)
    digest = F.md5(normalize_text(F.col("text")))
    kept = [
        drop_seen(batch, digest, "doc_id", index, f"batch-{run}")
        .select("doc_id", F.lit(run).cast("long").alias("run"), digest.alias("text_hash"))
        for run, batch in enumerate(batches(spark, sf_dir))
    ]
    return reduce(DataFrame.unionByName, kept)


@query(
    f"""SELECT run, count(*) AS n FROM (
          SELECT doc_id % {RUNS} AS run FROM documents WHERE NOT contains(lower(text), 'public')
          QUALIFY row_number() OVER (PARTITION BY md5({NORMAL_TEXT}) ORDER BY doc_id % {RUNS}, doc_id) = 1)
        GROUP BY run"""
)
def curate_across_runs(spark, sf_dir):
    """Curation batch by batch: tag filter, copies within and across runs, split."""
    index = SeenIndex(spark, scratch_path(spark, "seen"), buckets=8)
    kept = [
        curate_table(batch, "doc_id", exclude="public", seen=index, run=f"batch-{run}")
        .select(F.lit(run).cast("long").alias("run"))
        for run, batch in enumerate(batches(spark, sf_dir))
    ]
    return reduce(DataFrame.unionByName, kept).groupBy("run").agg(F.count("*").alias("n"))
