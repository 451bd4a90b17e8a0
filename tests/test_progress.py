import pytest
from pyspark.sql import functions as F

from gristmill.sources.snapshots import SnapshotLog
from gristmill.streaming import progress
from gristmill.streaming.progress import ProgressLog, progress_totals, read_endings, read_progress
from gristmill.streaming.streams import drop_copies_in_stream, write_batches


@pytest.fixture
def listening(spark):
    listeners = []

    def listen(*args):
        listeners.append(ProgressLog(spark, *args))
        spark.streams.addListener(listeners[-1])
        return listeners[-1]

    yield listen
    for listener in listeners:
        spark.streams.removeListener(listener)


def test_no_batch_is_forgotten(spark, tmp_path, listening, monkeypatch):
    """More batches than a query object remembers, in files of a few reports each."""
    monkeypatch.setattr(progress, "PER_FILE", 40)
    source, out, table = (str(tmp_path / name) for name in ("in", "out", "progress"))
    spark.range(0, 150, numPartitions=150).write.parquet(source)
    listener = listening(table, {"job": "a \"quoted\" name", "try": 1})
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    writer = stream.writeStream.queryName("many").format("noop").option("checkpointLocation", out)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert listener.wait(query)
    assert len(query.recentProgress) < 150
    rows = read_progress(spark, table)
    found = rows.where("rows_in > 0").select("batch_id", "rows_in", "query", "tags").collect()
    assert sorted(r["batch_id"] for r in found) == list(range(150))
    assert {(r["rows_in"], r["query"], r["tags"]["job"], r["tags"]["try"]) for r in found} == {(1, "many", 'a "quoted" name', "1")}
    total = progress_totals(rows).first()
    assert (total["query"], total["rows_in"], total["late_rows"]) == ("many", 150, 0)
    # Files hold 40 reports each, and replaced forms of them are gone.
    parts = SnapshotLog(spark, listener.log.path).current().parts
    assert sorted(map(int, parts)) == [0, 40, 80, 120]
    assert len(list(tmp_path.glob("progress/listener=*/*.jsonl"))) <= len(parts) + progress.FORMS_KEPT


def test_late_rows_and_endings_over_several_runs(spark, tmp_path, listening):
    source, out, table = (str(tmp_path / name) for name in ("in", "out", "progress"))
    assert read_progress(spark, table) is None and read_endings(spark, table) is None
    listener = listening(table)
    batches = [("2024-01-03 10:00", "a"), ("2024-01-03 12:00", "b"), ("2024-01-01 12:00", "new"), ("2024-01-01 13:00", "more")]
    for ts, k in batches:
        spark.sql(f"SELECT timestamp '{ts}' AS ts, '{k}' AS k").write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, k string").parquet(source)
        unique = drop_copies_in_stream(stream, F.md5("k"), "ts", "1 hour")
        query = write_batches(unique, out, str(tmp_path / "cp"), available_now=True)
        query.awaitTermination()
        assert listener.wait(query)
    total = progress_totals(read_progress(spark, table)).first()
    assert (total["rows_in"], total["late_rows"], total["query"]) == (4, 2, None)
    endings = read_endings(spark, table).collect()
    assert len({r["run_id"] for r in endings}) == 4 and {r["exception"] for r in endings} == {None}


def test_a_failed_run_is_told_and_a_report_that_failed_goes_with_the_next(spark, tmp_path, listening):
    source, table = str(tmp_path / "in"), str(tmp_path / "progress")
    listener = listening(table)
    spark.range(3).coalesce(1).write.parquet(source)

    def fail(batch, batch_id):
        raise ValueError("no batch today")

    stream = spark.readStream.schema("id long").parquet(source)
    query = stream.writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "cp")).start()
    with pytest.raises(Exception, match="no batch today"):
        query.awaitTermination()
    assert listener.wait(query)
    assert "no batch today" in read_endings(spark, table).first()["exception"]

    publish = listener.log.publish
    listener.log.publish = lambda *_: 1 / 0
    with pytest.raises(ZeroDivisionError):
        listener._add('{"tags":{"n":"1"},"ended":{"id":"x","runId":"y"}}')
    listener.log.publish = publish
    listener._add('{"tags":{"n":"2"},"ended":{"id":"x","runId":"z"}}')
    assert sorted(r["run_id"] for r in read_endings(spark, table).where("query_id = 'x'").collect()) == ["y", "z"]
