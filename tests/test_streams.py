import json

from pyspark.sql import functions as F

from gristmill.functions.record import VariantRecord
from gristmill.operators.gate import gate
from gristmill.operators.seen import SeenIndex
from gristmill.streaming.streams import (
    drop_copies_in_stream,
    late_rows,
    read_gated,
    read_late,
    read_unique,
    stream_jsonl,
    write_gate,
    write_unique,
)

GOOD = {"number": 7, "pier": "north", "crane": True}


def write(folder, name, rows):
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def judge(spec):
    def gated(batch):
        return gate(batch, VariantRecord(F.col("fields")), spec).drop("fields")

    return gated


def counts(spark, path):
    rows = spark.read.parquet(path)
    return tuple(rows.where(F.col("outcome") == name).count() for name in ("accepted", "quarantine"))


def test_stream_gate_resumes_and_agrees_with_batch(spark, spec, tmp_path):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    inbox.mkdir()
    write(inbox, "a.jsonl", [GOOD, {**GOOD, "number": 99}, "", "not json"])

    def run():
        stream = stream_jsonl(spark, str(inbox), max_files=1)
        write_gate(stream, judge(spec), out, checkpoint, available_now=True).awaitTermination()

    run()
    assert counts(spark, out) == (1, 2)
    write(inbox, "b.jsonl", [GOOD, GOOD])
    write(inbox, "c.jsonl", [{}])
    run()
    assert counts(spark, out) == (3, 3)
    run()
    assert counts(spark, out) == (3, 3)


def test_a_batch_run_twice_is_written_once(spark, spec, tmp_path):
    """A crash between writing and committing repeats the batch under the same id."""
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    write(inbox, "a.jsonl", [GOOD, "bad"])
    for checkpoint in ("cp1", "cp2"):
        stream = stream_jsonl(spark, str(inbox))
        query = write_gate(stream, judge(spec), out, str(tmp_path / checkpoint), available_now=True)
        query.awaitTermination()
    assert counts(spark, out) == (1, 1)


def test_stream_dedup(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:01:00", "A "), ("2024-01-01 00:02:00", "b")]
    df = spark.createDataFrame(rows, "ts string, text string").withColumn("ts", F.to_timestamp("ts"))

    def run():
        stream = spark.readStream.schema(df.schema).parquet(source)
        unique = drop_copies_in_stream(stream, F.md5(F.lower(F.trim("text"))), "ts", "1 hour")
        writer = unique.writeStream.format("parquet").option("path", out)
        writer = writer.option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.text.strip().lower() for r in spark.read.parquet(out).collect())

    df.write.parquet(source)
    assert run() == ["a", "b"]
    # copies in later files are dropped too
    df.write.mode("append").parquet(source)
    assert run() == ["a", "b"]
    assert spark.read.parquet(out).columns == ["ts", "text"]


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, k string"
    # One batch per file; the last one brings a new key two days late.
    for ts, k in [("2024-01-03 10:00", "a"), ("2024-01-03 12:00", "b"), ("2024-01-01 12:00", "new"), ("2024-01-03 13:00", "b")]:
        spark.sql(f"SELECT timestamp '{ts}' AS ts, '{k}' AS k").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        unique = drop_copies_in_stream(stream, F.md5("k"), "ts", "1 hour")
        writer = unique.writeStream.format("parquet").option("path", out)
        query = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        late = late_rows(query)
        assert late == (1 if k == "new" else 0)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) in (["a", "b"], ["a", "b", "b"])


def test_a_batch_being_written_is_not_read(spark, spec, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    write(inbox, "a.jsonl", [GOOD, "bad"])
    stream = stream_jsonl(spark, str(inbox))
    write_gate(stream, judge(spec), out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    half = spark.read.parquet(out).where("outcome = 'accepted'").drop("batch_id", "attempt")
    half.write.partitionBy("outcome").parquet(f"{out}/batch_id=7/attempt=x")
    assert spark.read.parquet(out).count() == 3
    assert read_gated(spark, out).count() == 2
    assert read_gated(spark, str(tmp_path / "none")) is None


def test_late_rows_have_a_table_and_state_is_freed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, ts timestamp, k string"
    batches = [
        [(1, "2024-01-03 10:00", "a"), (2, "2024-01-03 11:00", "a"), (3, None, "n")],
        [(4, "2024-01-03 12:00", "b"), (5, "2024-01-03 10:30", "a"), (6, "2024-01-01 12:00", "new"), (7, None, "n")],
        [(8, "2024-01-05 12:00", "b")],
        [(9, "2024-01-05 12:30", "a"), (10, "2024-01-05 10:30", "late"), (11, "2024-01-05 13:00", "b")],
    ]
    for n, rows in enumerate(batches):
        values = ", ".join(f"({i}, {'null' if ts is None else repr(ts)}, '{k}')" for i, ts, k in rows)
        spark.sql(f"SELECT id::long, ts::timestamp, k FROM VALUES {values} AS t(id, ts, k)").coalesce(1).write.mode(
            "append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        write_unique(
            stream, F.md5("k"), "ts", "1 hour", "id", out, str(tmp_path / "cp"), buckets=2, available_now=True
        ).awaitTermination()
        if n == 1:
            assert set(SeenIndex(spark, f"{out}/_index").log.current().parts) == {"batch-0", "batch-1"}
    kept = sorted((r["id"], r["batch_id"]) for r in read_unique(spark, out).collect())
    # The first two batches lie behind the last one's watermark: "a" is new again.
    assert kept == [(1, 0), (3, 0), (4, 1), (9, 3), (11, 3)]
    assert sorted(r["id"] for r in read_late(spark, out).collect()) == [6, 10]
    assert "batch-0" not in SeenIndex(spark, f"{out}/_index").log.current().parts
    assert read_late(spark, str(tmp_path / "none")) is None
