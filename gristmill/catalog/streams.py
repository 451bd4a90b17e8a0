"""The streaming forms, over files that Spark writes from the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gristmill.catalog.gates import VALID_EVENT
from gristmill.catalog.outputs import ATTEMPTS, answer_record, attempts, small_spec
from gristmill.catalog.registry import query, table
from gristmill.catalog.validation import EVENTS, event_spec, events, fields
from gristmill.functions import checks
from gristmill.functions.prompt import extract_json_text
from gristmill.operators.gate import gate
from gristmill.operators.records import with_record
from gristmill.session import scratch_path
from gristmill.streaming.answers import answers_in_stream
from gristmill.streaming.progress import ProgressLog, read_progress
from gristmill.streaming.streams import (
    drop_copies_in_stream,
    read_batches,
    read_gated,
    read_late,
    read_unique,
    stream_jsonl,
    write_batches,
    write_gate,
    write_unique,
)


@query(f"SELECT event_id, CASE WHEN {VALID_EVENT} THEN 'accepted' ELSE 'quarantine' END AS outcome "
       f"FROM {EVENTS}")
def g4_stream_gate(spark, sf_dir):
    """Events arriving as files, judged and set apart in one pass."""
    path, out = scratch_path(spark, "arriving"), scratch_path(spark, "gated")
    events(spark, sf_dir).select("event_id", "raw").write.parquet(path)
    stream = spark.readStream.schema("event_id long, raw string").parquet(path)

    def judge(batch):
        return gate(with_record(batch), fields(), event_spec()).drop("fields")

    write_gate(stream, judge, out, f"{out}-checkpoint", available_now=True).awaitTermination()
    return read_gated(spark, out).select("event_id", "outcome")


@query(f"SELECT count(*) AS rows, count(*) FILTER ({VALID_EVENT}) AS accepted FROM {EVENTS}")
def g4_stream_jsonl(spark, sf_dir):
    path, out = scratch_path(spark, "arriving"), scratch_path(spark, "gated")
    events(spark, sf_dir).select("raw").write.text(path)

    def judge(batch):
        return gate(batch, fields(), event_spec()).drop("fields")

    stream = stream_jsonl(spark, path, pattern="*.txt")
    write_gate(stream, judge, out, f"{out}-checkpoint", available_now=True).awaitTermination()
    accepted = F.count_if(F.col("outcome") == "accepted")
    return read_gated(spark, out).agg(F.count("*").alias("rows"), accepted.alias("accepted"))


@query("SELECT user_id, event_type, props, 1 AS n FROM events GROUP BY user_id, event_type, props")
def d4_stream_dedup(spark, sf_dir):
    """One row per user, type and properties; the watermark spans the table's time range."""
    path = scratch_path(spark, "arriving")
    columns = ["user_id", "event_type", "props"]
    table(spark, sf_dir, "events").select("ts", *columns).write.parquet(path)
    stream = spark.readStream.schema(
        "ts timestamp, user_id long, event_type string, props string"
    ).parquet(path)
    unique = drop_copies_in_stream(
        stream, F.md5(F.to_json(F.struct(*columns))), "ts", "3650 days"
    )
    out = scratch_path(spark, "unique")
    writer = unique.select(*columns).writeStream.format("parquet").option("path", out)
    writer = writer.option("checkpointLocation", f"{out}-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(*columns).agg(F.count("*").alias("n"))


# Events arrive in this many batches, dealt by identifier; each is late by so much of the days before.
ARRIVALS = 4
LATE_DAYS = 20

ARRIVED = f"""
  WITH arrived AS (SELECT *, event_id % {ARRIVALS} AS batch FROM events),
  marked AS (
    SELECT a.*, coalesce(ts < (SELECT max(ts) FROM arrived b WHERE b.batch < a.batch) - INTERVAL {LATE_DAYS} DAY, false)
      AS late FROM arrived a),
  kept AS (
    SELECT * FROM marked WHERE NOT late
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY batch, event_id) = 1)"""


def arrived(spark, sf_dir) -> str:
    """Run the stream of events, batch by batch in the order of writing; where its tables are."""
    path, out = scratch_path(spark, "arriving"), scratch_path(spark, "unique")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    for batch in range(ARRIVALS):
        rows.where(F.col("event_id") % ARRIVALS == batch).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    digest = F.md5(F.to_json(F.struct("user_id", "event_type")))
    write_unique(
        stream, digest, "ts", f"{LATE_DAYS} days", "event_id", out, f"{out}-checkpoint",
        buckets=8, available_now=True,
    ).awaitTermination()
    return out


@query(f"{ARRIVED} SELECT event_id, batch AS batch_id FROM kept")
def d4_stream_unique(spark, sf_dir):
    """First arrivals of each user and type; state holds what the watermark of days has not passed."""
    return read_unique(spark, arrived(spark, sf_dir)).select("event_id", F.col("batch_id").cast("long").alias("batch_id"))


@query(f"{ARRIVED} SELECT event_id, batch AS batch_id FROM marked WHERE late")
def d4_late_rows(spark, sf_dir):
    """The events that arrived behind the watermark, in a table of their own."""
    return read_late(spark, arrived(spark, sf_dir)).select("event_id", F.col("batch_id").cast("long").alias("batch_id"))


# The attempts of a prompt count up to this one; they arrive out of order, in batches by identifier.
MAX_ATTEMPTS = 10
# Longer than the events' whole time.
SPAN_DAYS = 40
# A batch arrives as files of about so many rows, which tasks share.
ROWS_PER_FILE = 100_000


@query(
    f"""WITH tried AS (SELECT *, event_id % {ARRIVALS} AS batch FROM {ATTEMPTS} WHERE attempt <= {MAX_ATTEMPTS}),
  firsts AS (SELECT *, min(attempt) FILTER (k <= 12) OVER (PARTITION BY prompt_id) AS valid FROM tried)
  SELECT prompt_id, coalesce(min(valid), max(attempt)) AS attempt,
         coalesce(arg_min(text, attempt) FILTER (attempt = valid), arg_max(text, attempt)) AS text,
         min(valid) IS NOT NULL AS accepted,
         min(valid) IS NULL AND count(*) < {MAX_ATTEMPTS} AS timed_out,
         CASE WHEN min(valid) IS NOT NULL THEN max(batch) FILTER (attempt <= valid)
              WHEN count(*) = {MAX_ATTEMPTS} THEN max(batch) END AS decided_in
  FROM firsts GROUP BY prompt_id"""
)
def r2_stream_answers(spark, sf_dir):
    """``best_of_n`` on a stream, with the batch in which each prompt could be answered; none at the end of its time."""
    path, out = scratch_path(spark, "arriving"), scratch_path(spark, "answers")
    rows = attempts(spark, sf_dir).select("event_id", "prompt_id", "attempt", "text", "ts")
    rows.withColumn("batch", F.col("event_id") % ARRIVALS).write.partitionBy("batch").parquet(f"{path}-all")
    rows = spark.read.parquet(f"{path}-all")
    # All batches have as many files, none of them empty: rows are dealt out in turn, and the least batch has enough.
    counts = {row["batch"]: row["count"] for row in rows.groupBy("batch").count().collect()}
    files = max(1, math.ceil(min(counts.get(batch, 0) for batch in range(ARRIVALS)) / ROWS_PER_FILE))
    for batch in range(ARRIVALS):
        part = rows.where(F.col("batch") == batch)
        part.drop("event_id", "batch").repartition(files).write.mode("append").parquet(path)
    # A row without an attempt, later than all by more than the delay, tells that time is up.
    end = rows.agg((F.max("ts") + F.expr(f"INTERVAL {2 * SPAN_DAYS} DAYS")).alias("ts"))
    columns = [F.lit(None).cast(field.dataType).alias(field.name) for field in rows.schema if field.name not in ("event_id", "ts", "batch")]
    end.select(*columns, "ts").coalesce(1).write.mode("append").parquet(path)

    schema = rows.drop("event_id", "batch").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    parsed = with_record(stream, extract_json_text(F.col("text")))
    answers = answers_in_stream(
        parsed, checks.schema_valid(answer_record(), small_spec()), "ts", f"{SPAN_DAYS} days", max_attempts=MAX_ATTEMPTS
    )
    write_batches(answers, out, f"{out}-checkpoint", available_now=True).awaitTermination()
    decided = F.when(~F.col("timed_out"), F.col("batch_id").cast("long"))
    return read_batches(spark, out).withColumn("decided_in", decided).drop("batch_id")


@query(
    f"""WITH arrived AS (SELECT *, event_id % {ARRIVALS} AS batch FROM events),
  firsts AS (SELECT user_id, event_type, min(batch) AS batch FROM arrived GROUP BY ALL)
  SELECT a.batch AS batch_id, 'events' AS job, count(*) AS rows_in,
         (SELECT count(*) FROM firsts f WHERE f.batch <= a.batch) AS state_rows
  FROM arrived a GROUP BY a.batch"""
)
def g7_stream_progress(spark, sf_dir):
    """What each batch of a deduplicating stream read and how many groups its state held, from the table of reports."""
    path, out, reports = (scratch_path(spark, name) for name in ("arriving", "unique", "progress"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    for batch in range(ARRIVALS):
        rows.where(F.col("event_id") % ARRIVALS == batch).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    digest = F.md5(F.to_json(F.struct("user_id", "event_type")))
    unique = drop_copies_in_stream(stream, digest, "ts", f"{SPAN_DAYS} days")
    listener = ProgressLog(spark, reports, {"job": "events"})
    spark.streams.addListener(listener)
    try:
        stream = write_batches(unique, out, f"{out}-checkpoint", available_now=True)
        stream.awaitTermination()
        if not listener.wait(stream):
            raise TimeoutError("the stream's last reports have not come in")
    finally:
        spark.streams.removeListener(listener)
    read = read_progress(spark, reports).where("rows_in > 0")
    return read.select("batch_id", F.col("tags")["job"].alias("job"), "rows_in", "state_rows")
