"""Exact deduplication against all earlier runs.

The hashes that earlier runs have kept form an index: a Parquet table bucketed by hash, one part a
run, with a Bloom filter of each bucket beside it. A new batch meets the filters first. What they
let pass is joined with the index bucket by bucket, where it lies: the batch is dealt out by the
index's own bucketing, so the index is never shuffled, and if only few hashes are in question just
the buckets that can hold them are opened. What is not found is new, and becomes the next part.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import free_scratch, scratch_path
from gristmill.sources.snapshots import Snapshot, SnapshotLog

# Bits of a filter per hash, and bits set by each: one in about 700 hashes passes by chance.
FILTER_BITS = 16
PROBES = 5
WORD = 64

# Hashes in question up to which the index is asked for them by name, which opens only their buckets.
NAMED_HASHES = 1_000

# Hashes of a batch that are held against one filter at a time.
CHUNK = 50_000


def bucket_of(hash_column: str, buckets: int) -> Column:
    """The bucket that Spark's own writer gives a hash."""
    return F.pmod(F.hash(hash_column), F.lit(buckets))


def probes(hash_column: Column, bits: Column) -> list[Column]:
    """Positions of a hash in a filter of so many bits."""
    return [F.pmod(F.xxhash64(hash_column, F.lit(i)), bits) for i in range(PROBES)]


class SeenIndex:
    """An index of kept hashes below a folder; ``buckets`` is fixed by the first run.

    One writer at a time: of two that publish on the same state the second fails, and can run again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = SnapshotLog(spark, self.path)
        first = next(iter(self.log.current().parts.values()), None)
        self.buckets = first["buckets"] if first else buckets

    @property
    def name(self) -> str:
        """The table's name in the session's catalog."""
        return "seen_" + hashlib.md5(f"{self.path}:{self.buckets}".encode()).hexdigest()

    def table(self, *runs: str) -> DataFrame:
        """The indexed hashes of some runs, as a bucketed scan; others are passed over, published or not."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (hash BINARY, run STRING) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}/hashes'"
        )
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).where(F.col("run").isin(*runs)).select("hash")

    def filters(self, snapshot: Snapshot) -> DataFrame:
        paths = [part["path"] for part in snapshot.parts.values()]
        return self.spark.read.schema("bucket int, words array<bigint>").parquet(*paths)

    def in_question(self, hashes: DataFrame, snapshot: Snapshot) -> DataFrame:
        """Those of some distinct hashes that a filter of an earlier run lets pass, and perhaps a few more.

        Hashes of a bucket are gathered in lists of about ``CHUNK``; a list meets the bucket's filter once.
        """
        n = max(1, hashes.count() // (self.buckets * CHUNK))
        lists = (
            hashes.withColumn("bucket", bucket_of("hash", self.buckets))
            .groupBy("bucket", F.pmod(F.xxhash64("hash"), F.lit(n)).alias("chunk"))
            .agg(F.collect_list("hash").alias("hashes"))
        )
        bits = F.size("words") * WORD

        def passes(value: Column) -> Column:
            found = F.lit(True)
            for at in probes(value, bits):
                word = F.get("words", F.floor(at / WORD).cast("int"))
                found = found & (F.expr("1L").bitwiseAND(F.call_function("shiftright", word, (at % WORD).cast("int"))) == 1)
            return found

        met = lists.join(self.filters(snapshot), "bucket")
        return met.select(F.explode(F.filter("hashes", passes)).alias("hash")).distinct()

    def seen(self, hashes: DataFrame, snapshot: Snapshot) -> DataFrame:
        """Those of some distinct hashes that the index holds."""
        if not snapshot.parts:
            return hashes.limit(0)
        stage = scratch_path(self.spark, "in-question")
        self.in_question(hashes, snapshot).write.parquet(stage)
        asked = self.spark.read.schema("hash binary").parquet(stage)
        index = self.table(*snapshot.parts)
        few = asked.limit(NAMED_HASHES + 1).collect()
        if len(few) <= NAMED_HASHES:
            index = index.where(F.col("hash").isin(*[bytes(r["hash"]) for r in few]) if few else F.lit(False))
        return asked.join(index.hint("merge"), "hash", "left_semi")

    def add(self, hashes: DataFrame, run: str, snapshot: Snapshot) -> Snapshot:
        """Write a run's new hashes and their filters, then publish both by one entry."""
        if run in snapshot.parts:
            raise ValueError(f"run {run} is indexed already")
        where = f"{self.path}/hashes/run={run}"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        # What an attempt that ended before its entry has left; no snapshot names it.
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.table(run)
        dealt = hashes.select("hash", F.lit(run).alias("run")).repartition(self.buckets, "hash")
        (
            dealt.write.format("parquet").mode("append").partitionBy("run")
            .bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(self.name)
        )
        filters = self.log.folder("filters")
        filled_filters(self.table(run), self.buckets).write.parquet(filters)
        return self.log.publish(snapshot, {run: {"path": filters, "buckets": self.buckets}})


    def forget(self, runs: list[str]) -> None:
        """Drop what some runs have kept: first from the log, then the folders."""
        snapshot = self.log.current()
        gone = [run for run in runs if run in snapshot.parts]
        if not gone:
            return
        self.log.publish(snapshot, {}, tuple(gone))
        for run in gone:
            for where in (f"{self.path}/hashes/run={run}", snapshot.parts[run]["path"]):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(where)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def filled_filters(hashes: DataFrame, buckets: int) -> DataFrame:
    """``bucket, words``: a Bloom filter of each bucket, sized by what it holds."""
    placed = hashes.withColumn("bucket", bucket_of("hash", buckets).cast("int"))
    words = F.greatest(F.lit(1), F.ceil(F.count("*") * FILTER_BITS / WORD)).cast("int")
    sizes = placed.groupBy("bucket").agg(words.alias("size"))
    marks = placed.join(sizes, "bucket").select(
        "bucket", F.explode(F.array(*probes(F.col("hash"), F.col("size").cast("long") * WORD))).alias("at")
    )
    one = F.call_function("shiftleft", F.expr("1L"), (F.col("at") % WORD).cast("int"))
    zeros = sizes.select("bucket", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("word"), F.expr("0L").alias("bits"))
    filled = (
        marks.select("bucket", F.floor(F.col("at") / WORD).cast("int").alias("word"), one.alias("bits"))
        .unionByName(zeros)
        .groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    )
    listed = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return filled.groupBy("bucket").agg(listed.alias("listed")).select(
        "bucket", F.transform("listed", lambda x: x["bits"]).alias("words")
    )


def new_keys(df: DataFrame, copies_of: Column, key: str, index: SeenIndex, run: str) -> DataFrame:
    """Keys of the first row of every group of copies that no earlier run has kept; they are indexed.

    Running the same ``run`` again gives the keys it kept, told by its own part of the index, so a job that
    ended after publishing loses nothing. The index is as before if it ended earlier.
    """
    snapshot = index.log.current()
    # Rows without a hash are copies of each other, under an empty one.
    own = F.coalesce(F.unhex(copies_of), F.lit(b"")).alias("hash")
    firsts = df.select(own, key).groupBy("hash").agg(F.min(key).alias(key))
    if run in snapshot.parts:
        return firsts.join(index.table(run), "hash", "left_semi").select(key)
    stage, new = (scratch_path(index.spark, label) for label in ("firsts", "new"))
    firsts.write.parquet(stage)
    firsts = index.spark.read.schema(firsts.schema).parquet(stage)
    firsts.join(index.seen(firsts.select("hash"), snapshot), "hash", "left_anti").write.parquet(new)
    kept = index.spark.read.schema(firsts.schema).parquet(new)
    index.add(kept.select("hash"), run, snapshot)
    free_scratch(index.spark, stage)
    return kept.select(key)


def drop_seen(df: DataFrame, copies_of: Column, key: str, index: SeenIndex, run: str) -> DataFrame:
    """Keep the first row of every group of copies that no earlier run has kept, and index it.

    ``copies_of`` is a hash in hex, ``key`` a unique ordering key of the batch. Hashes are grouped before
    they travel, so a group of copies costs one small row a task; whole rows move once, to meet their keys.
    """
    return df.join(new_keys(df, copies_of, key, index, run), key, "left_semi")
