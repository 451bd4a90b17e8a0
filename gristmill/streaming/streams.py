"""The gate and the deduplication on unbounded tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.functions.text import strip
from gristmill.operators.records import with_record
from gristmill.operators.seen import SeenIndex, new_keys
from gristmill.sources.snapshots import SnapshotLog

# Keys of a long watermark outgrow executor memory; this store keeps them on disk.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_jsonl(
    spark: SparkSession, path: str, *, pattern: str = "*.jsonl", max_files: int | None = None
) -> DataFrame:
    """New JSONL files as a stream; unreadable lines have null ``fields``, for a gate to refuse."""
    reader = spark.readStream.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(path)
    return with_record(lines.where(strip(F.col("value")) != "").withColumnRenamed("value", "raw"))


def drop_copies_in_stream(
    stream: DataFrame, copies_of: Column, event_time: str, delay: str
) -> DataFrame:
    """Keep the first arriving row of every group of copies within the watermark delay.

    State holds one hash per group and is freed as the watermark passes. Rows that arrive behind
    the watermark are left out, first ones too, as their group may have been forgotten;
    ``late_rows`` tells how many, and a delay as long as sources may lag keeps them.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        stream.withColumn("_copies_of", copies_of)
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["_copies_of"])
        .drop("_copies_of")
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's recent batches left out for arriving behind the watermark."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def read_gated(spark: SparkSession, path: str) -> DataFrame | None:
    """The batches that ``write_gate`` has finished; None before the first.

    A log names them: no data folder is listed to find them, and a batch that is being written, or was
    left half written, has no entry.
    """
    return _parts(spark, path, SnapshotLog(spark, path).current().paths)


def _parts(spark: SparkSession, path: str, folders: list[str], label: str = "attempt") -> DataFrame | None:
    if not folders:
        return None
    return spark.read.option("basePath", path).parquet(*folders).drop(label)


def write_gate(
    stream: DataFrame,
    gate: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    *,
    available_now: bool = False,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Write every micro-batch to one Parquet table, accepted and quarantined rows apart.

    The table is partitioned by ``batch_id`` and ``outcome`` (``accepted`` or ``quarantine``). A batch
    is written to a folder of its own and becomes visible by one entry of the table's log; run again
    after a failure it finds its entry, or writes a new folder. So every row arrives exactly once, and the
    gate is evaluated in a single pass. ``read_gated`` reads the batches that are complete.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log = SnapshotLog(batch.sparkSession, path)
        snapshot, key = log.current(), f"batch_id={batch_id}"
        if key in snapshot.parts:
            return
        outcome = F.when(F.col("accepted"), "accepted").otherwise("quarantine")
        gated = gate(batch).withColumn("outcome", outcome).drop("accepted")
        folder = log.folder(key)
        gated.write.partitionBy("outcome").parquet(folder)
        log.publish(snapshot, {key: {"path": folder}})

    return _started(stream, write, checkpoint, available_now, interval)


def _started(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool, interval: str
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def write_unique(
    stream: DataFrame,
    copies_of: Column,
    event_time: str,
    delay: str,
    key: str,
    path: str,
    checkpoint: str,
    *,
    buckets: int = 64,
    available_now: bool = False,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Keep the first arriving row of every group of copies, and the late rows apart.

    The watermark of a batch is the latest event time of the batches before it, less the delay. Rows behind it
    go to a table of their own, as their group may have been forgotten; rows without a time are never
    late. What was kept is an index of hashes, one part a batch; a part whose latest event time the watermark
    has passed is dropped, so state is bounded by what arrives within the delay. ``key`` is unique and
    tells which of a batch's copies comes first. A batch becomes visible by one entry of the log.
    ``read_unique`` and ``read_late`` read both tables.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log, index = SnapshotLog(spark, path), SeenIndex(spark, f"{path}/_index", buckets)
        snapshot, name = log.current(), f"batch_id={batch_id}"
        if name in snapshot.parts:
            return
        latest = max((p["latest"] for p in snapshot.parts.values() if p["latest"] is not None), default=None)
        time = F.unix_micros(F.col(event_time).cast("timestamp"))
        span = F.expr(f"unix_micros(timestamp '1970-01-01 00:00:00 UTC' + interval {delay})")
        # The one row says what the delay is in microseconds, and the batch's latest time.
        facts = batch.agg(F.max(time).alias("latest"), F.first(span).alias("delay")).first()
        mark = None if latest is None or facts["delay"] is None else latest - facts["delay"]
        late = F.lit(False) if mark is None else F.coalesce(time < F.lit(mark), F.lit(False))
        if mark is not None:
            gone = [k for k, p in snapshot.parts.items() if p["latest"] is not None and p["latest"] < mark]
            index.forget([f"batch-{k.partition('=')[2]}" for k in gone])
        fresh = batch.where(~late)
        keys = new_keys(fresh, copies_of, key, index, f"batch-{batch_id}").withColumn("_first", F.lit(True))
        # One pass over the batch writes what is kept and what is late; copies are left out.
        marked = batch.withColumn("late", late).join(keys, key, "left").where(F.col("late") | F.col("_first"))
        folder = log.folder(name)
        marked.drop("_first").write.partitionBy("late").parquet(folder)
        log.publish(snapshot, {name: {"path": folder, "latest": facts["latest"]}})

    return _started(stream, write, checkpoint, available_now, interval)


def read_unique(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that ``write_unique`` has kept, with their ``batch_id``."""
    found = _parts(spark, path, SnapshotLog(spark, path).current().paths)
    return None if found is None else found.where("late = 'false'").drop("late")


def read_late(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that arrived behind the watermark, with their ``batch_id``."""
    found = _parts(spark, path, SnapshotLog(spark, path).current().paths)
    return None if found is None else found.where("late = 'true'").drop("late")


# Not a name that rows of attempts have themselves.
WRITTEN = "gristmill_written"


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, *, available_now: bool = False, interval: str = "30 seconds"
) -> StreamingQuery:
    """Append every micro-batch to a Parquet table, with its ``batch_id``; ``read_batches`` reads it.

    As in ``write_gate`` a batch becomes visible whole, by one entry of the table's log, and only once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log = SnapshotLog(batch.sparkSession, path)
        snapshot, key = log.current(), f"batch_id={batch_id}"
        if key in snapshot.parts:
            return
        folder = log.folder(key, WRITTEN)
        batch.write.parquet(folder)
        log.publish(snapshot, {key: {"path": folder}})

    return _started(stream, write, checkpoint, available_now, interval)


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that ``write_batches`` has written; None before the first batch."""
    return _parts(spark, path, SnapshotLog(spark, path).current().paths, WRITTEN)
