"""Answers chosen on a stream, against plain Python."""

import random

import pyarrow as pa
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from gristmill.catalog import load
from gristmill.catalog import streams as catalog_streams
from gristmill.streaming.answers import NO_ATTEMPT, NO_TIME, answers_in_stream, joined, runs_of
from gristmill.streaming.streams import read_batches, write_batches

BIG = 2**60
SCHEMA = "prompt_id long, attempt int, text string, ok boolean, ts timestamp, seen string"


def arrow(rows):
    names = ["prompt", "attempt", "text", "valid", "time"]
    types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.timestamp("us", "UTC")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def plain_runs(rows):
    """Runs by going through the numbers of each prompt one by one."""
    out = []
    for prompt in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == prompt]
        numbers = sorted({r[1] for r in mine})
        runs = []
        for n in numbers:
            if runs and runs[-1][1] == n - 1:
                runs[-1][1] = n
            else:
                runs.append([n, n])
        for start, stop in runs:
            inside = [r for r in mine if start <= r[1] <= stop]

            def best(of):
                return min(of, key=lambda r: (not r[3], r[2] is None, r[2] or ""))

            valid = [r for r in inside if r[3]]
            low = min((r[1] for r in valid), default=NO_ATTEMPT)
            valid_text = best([r for r in valid if r[1] == low])[2] if valid else None
            times = [r[4] for r in inside if r[4] is not None]
            millis = max(times) // 1000 if times else NO_TIME
            last = best([r for r in inside if r[1] == stop])[2]
            out.append((prompt, start, stop, low, millis, valid_text, last, max(times, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(20))
def test_runs_against_plain_python(seed):
    draw = random.Random(seed)
    rows = [
        (draw.choice(["a", "b", None]), draw.choice([-1, 0, 1, 2, 3, 5, 8, BIG, BIG + 1]), draw.choice(["x", "y", "", None]),
         draw.random() < 0.3, draw.choice([None, 5_000, 7_999_000]))
        for _ in range(draw.choice([1, 4, 40]))
    ]
    batch = runs_of(arrow(rows))
    columns = [batch[name].cast(pa.int64()) if name == "time" else batch[name] for name in batch.schema.names]
    assert sorted(zip(*(c.to_pylist() for c in columns), strict=True), key=repr) == plain_runs(rows)


def test_joined_runs():
    assert joined([], [(3, 4), (1, 1)]) == [1, 1, 3, 4]
    assert joined([1, 1, 3, 4], [(2, 2), (9, 9), (3, 3)]) == [1, 4, 9, 9]


def run(spark, tmp_path, batches, **options):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA.replace("ts timestamp", "ts string"))
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        answers = answers_in_stream(stream, F.col("ok"), "ts", "1 hour", **options)
        write_batches(answers, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    rows = read_batches(spark, out)
    assert rows.columns == ["prompt_id", "attempt", "text", "accepted", "timed_out", "batch_id"]
    return sorted(tuple(r)[:5] for r in rows.collect())


def test_answers_wait_for_earlier_attempts_and_for_the_end_of_time(spark, tmp_path):
    batches = [
        [
            (1, 2, "valid but second", True, "2024-01-01 10:00"),
            (2, 1, "bad", False, "2024-01-01 10:00"), (2, 2, "good", True, "2024-01-01 10:00"),
            (3, 2, "unsure", True, "2024-01-01 10:00"),
            (4, 1, "first", False, "2024-01-01 10:00"), (4, 3, "third", False, "2024-01-01 10:00"),
            (5, 1, "no verdict", None, None), (BIG + 1, 4, None, True, "2024-01-01 10:00"),
            (6, 7, "beyond the limit", True, "2024-01-01 10:00"),
        ],
        [
            (1, 1, "valid and first", True, "2024-01-01 10:10"), (2, 3, "too late to matter", True, "2024-01-01 10:10"),
            (4, 2, "second", False, "2024-01-01 10:10"), (4, 4, "fourth", False, "2024-01-01 10:10"),
        ],
        # Time passes for all; prompt 4 had its four attempts and was answered before.
        [(None, None, None, None, "2024-01-01 13:00")],
        # Behind the watermark.
        [(7, 1, "late", True, "2024-01-01 09:00")],
    ]
    assert run(spark, tmp_path, batches, max_attempts=4) == [
        (1, 1, "valid and first", True, False),
        (2, 2, "good", True, False),
        (3, 2, "unsure", True, True),
        (4, 4, "fourth", False, False),
        (5, 1, "no verdict", False, True),
        (BIG + 1, 4, None, True, True),
    ]


def test_one_hot_prompt_null_prompts_and_repeated_numbers(spark, tmp_path):
    hot = [(9, n, f"t{n}", n == 3_000, "2024-01-01 10:00") for n in range(1, 4_001)]
    random.Random(1).shuffle(hot)
    rows = [*hot, (0, 1, "z", True, "2024-01-01 10:00"), (0, 1, "b", True, "2024-01-01 10:00"), (0, 1, "a", False, "2024-01-01 10:00")]
    first = [(None, 1, "nobody", False, "2024-01-01 10:00"), (None, 2, "", False, "2024-01-01 10:00")]
    out = run(spark, tmp_path, [rows]) + run(
        spark, tmp_path / "null", [first, [(None, None, None, None, "2024-01-01 13:00")]]
    )
    assert out == [(0, 1, "b", True, False), (9, 3_000, "t3000", True, False), (None, 2, "", False, True)]


def all_answers(spark, path, batches, **options):
    """As ``run``, for prompts that may be null."""
    source, out = str(path / "in"), str(path / "out")
    for rows in batches:
        df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA.replace("ts timestamp", "ts string"))
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        answers = answers_in_stream(stream, F.col("ok"), "ts", "1 hour", **options)
        write_batches(answers, out, str(path / "cp"), available_now=True).awaitTermination()
    return sorted((tuple(r)[:5] for r in read_batches(spark, out).collect()), key=repr)


def test_prompts_that_share_a_bucket_keep_their_own_time(spark, tmp_path):
    """One bucket for all: answers, marks and times of prompts are apart, also beside rows that only move the time."""
    batches = [
        [
            (BIG + 1, 1, "first", False, "2024-01-01 10:00"), (BIG + 2, 2, "early", True, "2024-01-01 10:00"),
            (None, 1, "nobody", False, "2024-01-01 11:10"), (3, 1, "good", True, "2024-01-01 10:00"), (4, 9, "beyond", True, None),
        ],
        # Prompts BIG + 1, BIG + 2 and 3 are over, without rows of theirs; the null one and 5 are not.
        [(5, 2, "five", True, "2024-01-01 12:00"), (None, 2, None, True, "2024-01-01 11:20")],
        [(BIG + 1, 1, "anew", True, "2024-01-01 12:30"), (None, None, None, None, "2024-01-01 12:20")],
        [(None, None, None, None, "2024-01-01 16:00")],
    ]
    want = [
        (BIG + 1, 1, "anew", True, False), (BIG + 1, 1, "first", False, True), (BIG + 2, 2, "early", True, True),
        (3, 1, "good", True, False), (5, 2, "five", True, True), (None, 2, None, True, False),
    ]
    for buckets in (1, 4_096):
        got = all_answers(spark, tmp_path / str(buckets), batches, max_attempts=4, buckets=buckets)
        assert got == sorted(want, key=repr)


def test_state_has_a_row_for_a_bucket_not_for_a_prompt(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "prompt_id string, attempt int, text string, ok boolean, ts timestamp"
    rows = spark.range(500).select(
        F.concat(F.lit('"é\\ '), "id").alias("prompt_id"), F.lit(1).alias("attempt"), F.lit("x").alias("text"),
        (F.col("id") % 2 == 0).alias("ok"), F.current_timestamp().alias("ts"),
    )
    rows.write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    answers = answers_in_stream(stream, F.col("ok"), "ts", "1 hour", buckets=8)
    query = write_batches(answers, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 8
    answered = read_batches(spark, str(tmp_path / "out")).select("prompt_id", "accepted").collect()
    assert sorted(answered) == sorted((f'"é\\ {n}', True) for n in range(0, 500, 2))


def test_a_batch_of_many_files_stays_one_batch(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog_streams, "ROWS_PER_FILE", 20)
    name = "r2_stream_answers"
    assert compare(spark, connect(sf_dir), catalog_streams.r2_stream_answers, load().ORACLES[name], sf_dir) is None
