"""What streams report about their batches, kept as a table."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gristmill.sources.snapshots import SnapshotLog

# Reports in one file; so many of its earlier forms stay for readers that have just looked.
PER_FILE = 100
FORMS_KEPT = 5

REPORT = """tags map<string,string>, ended struct<id: string, runId: string, exception: string>, progress struct<
  id: string, runId: string, name: string, timestamp: string, batchId: long, batchDuration: long,
  durationMs: map<string,long>, eventTime: map<string,string>,
  stateOperators: array<struct<operatorName: string, numRowsTotal: long, numRowsUpdated: long,
    numRowsRemoved: long, numRowsDroppedByWatermark: long, memoryUsedBytes: long>>,
  sources: array<struct<description: string, numInputRows: long>>, sink: struct<description: string, numOutputRows: long>,
  observedMetrics: string>"""


class ProgressLog(StreamingQueryListener):
    """Keeps every progress report of the session's streams, with tags of the application's own.

    ``spark.streams.addListener(ProgressLog(spark, path, {"job": "nightly"}))`` is all it takes. A query object
    holds only its newest reports; this table holds all of them, over all runs and applications.
    A report is in the table as soon as it is handled: the newest file, of at most 100 reports, is written
    anew with it and replaces its earlier form by one entry of a log. A report that could not be written goes with
    the next one. Each listener writes below a folder of its own, so any number may share a table.
    """

    def __init__(self, spark: SparkSession, path: str, tags: dict[str, str] | None = None):
        self.log = SnapshotLog(spark, f"{path.rstrip('/')}/listener={uuid.uuid4().hex}")
        self.tags = json.dumps({k: str(v) for k, v in (tags or {}).items()})
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._system = self._hadoop.Path(self.log.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._rows: list[str] = []
        self._first = 0
        self._earlier: list[str] = []
        self._lock = threading.Lock()
        self._ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self._end_of(event.runId)

    def onQueryProgress(self, event) -> None:
        self._add(f'{{"tags":{self.tags},"progress":{_flat(event.progress.json)}}}')

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        ended = {"id": str(event.id), "runId": str(event.runId), "exception": event.exception}
        try:
            self._add(f'{{"tags":{self.tags},"ended":{json.dumps(ended)}}}')
        finally:
            self._end_of(event.runId).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Wait until all reports of a query that has ended are in the table; False if that took too long."""
        return self._end_of(query.runId).wait(seconds)

    def _end_of(self, run: object) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(str(run), threading.Event())

    def _add(self, row: str) -> None:
        with self._lock:
            self._rows.append(row)
            while self._rows:
                rows = self._rows[:PER_FILE]
                file = f"{self.log.path}/{self._first:012d}-{uuid.uuid4().hex[:12]}.jsonl"
                stream = self._system.create(self._hadoop.Path(file), False)
                try:
                    stream.write(bytearray("".join(f"{r}\n" for r in rows).encode()))
                finally:
                    stream.close()
                self.log.publish(self.log.current(), {str(self._first): {"path": file}})
                self._earlier.append(file)
                if len(rows) < PER_FILE:
                    break
                # Full: its last form stays, and the rows leave the driver.
                self._rows, self._first = self._rows[PER_FILE:], self._first + PER_FILE
                self._forget(self._earlier[:-1])
                self._earlier = []
            self._forget(self._earlier[:-FORMS_KEPT])
            self._earlier = self._earlier[-FORMS_KEPT:]

    def _forget(self, files: list[str]) -> None:
        for file in files:
            self._system.delete(self._hadoop.Path(file), False)


def _flat(progress: str) -> str:
    """A report on one line, its observed metrics as text, as their fields differ from query to query."""
    report = json.loads(progress)
    if "observedMetrics" in report:
        report["observedMetrics"] = json.dumps(report["observedMetrics"])
    return json.dumps(report)


def _reports(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{path}/listener=*"))
    folders = [str(status.getPath()) for status in found or ()]
    files = [file for folder in folders for file in SnapshotLog(spark, folder).current().paths]
    if not files:
        return None
    return spark.read.text(files).select(F.from_json("value", REPORT).alias("r")).select("r.*")


def _total(items: Column, field: str) -> Column:
    add = lambda total, item: total + F.coalesce(item[field], F.lit(0))
    return F.coalesce(F.aggregate(items, F.lit(0).cast("long"), add), F.lit(0))


def read_progress(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per report: what a batch of a query read, left out as late, kept as state and took in time.

    ``None`` before the first report. ``observed`` is the JSON of the metrics a query observes.
    """
    reports = _reports(spark, path)
    if reports is None:
        return None
    p, states = F.col("progress"), F.col("progress.stateOperators")
    return reports.where(p.isNotNull()).select(
        "tags",
        p["name"].alias("query"),
        p["id"].alias("query_id"),
        p["runId"].alias("run_id"),
        p["batchId"].alias("batch_id"),
        F.to_timestamp(p["timestamp"]).alias("started"),
        p["batchDuration"].alias("millis"),
        p["durationMs"].alias("steps"),
        F.to_timestamp(p["eventTime"]["watermark"]).alias("watermark"),
        _total(p["sources"], "numInputRows").alias("rows_in"),
        _total(states, "numRowsDroppedByWatermark").alias("late_rows"),
        _total(states, "numRowsTotal").alias("state_rows"),
        _total(states, "memoryUsedBytes").alias("state_bytes"),
        p["observedMetrics"].alias("observed"),
    )


def read_endings(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per run of a query that has ended, with its error if it failed."""
    reports = _reports(spark, path)
    if reports is None:
        return None
    e = F.col("ended")
    return reports.where(e.isNotNull()).select(
        "tags", e["id"].alias("query_id"), e["runId"].alias("run_id"), e["exception"].alias("exception")
    )


def progress_totals(progress: DataFrame) -> DataFrame:
    """All batches of each query over all its runs: rows read, rows left out as late, and the time taken.

    A batch that was begun again after a failure is reported by each run; its latest report counts.
    """
    once = progress.groupBy("query_id", "batch_id").agg(
        F.max_by(F.struct("query", "rows_in", "late_rows", "millis", "state_rows"), "started").alias("last")
    )
    return once.groupBy("query_id").agg(
        F.max("last.query").alias("query"),
        F.count("*").alias("batches"),
        F.sum("last.rows_in").alias("rows_in"),
        F.sum("last.late_rows").alias("late_rows"),
        F.sum("last.millis").alias("millis"),
        F.max("last.state_rows").alias("most_state_rows"),
    )
