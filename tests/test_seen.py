"""Deduplication across runs: equal to one pass, atomic, and without a shuffle of the index."""

import re

import pytest
from pyspark.sql import functions as F

from gristmill.operators import seen
from gristmill.operators.seen import SeenIndex, drop_seen
from gristmill.plans.curation import curate_table
from gristmill.sources.snapshots import LOG, Conflict, SnapshotLog

def digest():
    return F.md5("text")


@pytest.fixture
def index(spark, tmp_path):
    return SeenIndex(spark, str(tmp_path / "index"), buckets=4)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "key long, text string")


def keys(df):
    return sorted(r["key"] for r in df.collect())


def test_runs_know_each_other(spark, index):
    first = rows(spark, [(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)])
    assert keys(drop_seen(first, digest(), "key", index, "one")) == [1, 2, 4]
    second = rows(spark, [(1, "b"), (2, "c"), (3, "c"), (6, None), (7, "")])
    assert keys(drop_seen(second, digest(), "key", index, "two")) == [2, 7]
    # A run that is run again keeps what it kept, and adds nothing.
    assert keys(drop_seen(second, digest(), "key", index, "two")) == [2, 7]
    assert keys(drop_seen(rows(spark, []), digest(), "key", index, "three")) == []
    again = SeenIndex(spark, index.path, buckets=99)
    assert again.buckets == 4
    assert keys(drop_seen(rows(spark, [(9, "c"), (8, "d")]), digest(), "key", again, "four")) == [8]


def test_a_run_that_ends_before_its_entry_leaves_the_index(spark, index, monkeypatch):
    drop_seen(rows(spark, [(1, "a")]), digest(), "key", index, "one")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched, pytest.raises(RuntimeError, match="lost"):
        patched.setattr(seen.SnapshotLog, "publish", lost)
        drop_seen(rows(spark, [(1, "b")]), digest(), "key", index, "two")
    assert keys(drop_seen(rows(spark, [(5, "b"), (6, "a")]), digest(), "key", index, "two")) == [5]


@pytest.mark.parametrize("named, opened", [(1_000, 1), (0, 4)])
def test_the_index_is_not_shuffled(spark, index, monkeypatch, named, opened):
    monkeypatch.setattr(seen, "NAMED_HASHES", named)
    many = spark.range(3_000).select(F.col("id").alias("key"), F.col("id").cast("string").alias("text"))
    drop_seen(many, digest(), "key", index, "one")
    one = rows(spark, [(1, "17")]).select(F.unhex(digest()).alias("hash"))
    found = index.seen(one, index.log.current())
    plan = found._jdf.queryExecution().executedPlan().toString()
    side = plan[: plan.index("Bucketed: true")].rpartition("Sort [hash")[2]
    assert "Exchange" not in side
    assert re.search(r"SelectedBucketsCount: (\d) out of 4", plan)[1] == str(opened)
    assert found.count() == 1


def test_filters_pass_few_strangers_and_no_loss(spark, index):
    known = spark.range(4_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("hash"))
    snapshot = index.add(known, "one", index.log.current())
    assert index.in_question(known, snapshot).count() == 4_000
    strangers = spark.range(10_000, 30_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("hash"))
    assert index.in_question(strangers, snapshot).count() < 100
    assert index.seen(strangers, snapshot).count() == 0


def test_curation_with_an_index(spark, index):
    one = rows(spark, [(i, f"text {i % 7}") for i in range(20)])
    assert curate_table(one, "key", seen=index, run="a").count() == 7
    assert curate_table(rows(spark, [(1, "text 3"), (2, "new")]), "key", seen=index, run="b").count() == 1
    with pytest.raises(ValueError):
        curate_table(one, "key", seen=index)


def test_snapshots(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "table"), whole_every=4)
    state = log.current()
    assert (state.version, state.paths) == (0, [])
    for i in range(30):
        state = log.publish(state, {str(i): {"path": log.folder("data")}}, (str(i - 3),) if i >= 3 else ())
        assert log.current() == state
    assert list(state.parts) == ["27", "28", "29"]
    assert len(list((tmp_path / "table" / LOG).glob("*.json"))) < 12
    with pytest.raises(Conflict):
        log.publish(SnapshotLog(spark, log.path).current().__class__(29, {}), {"x": {"path": "y"}})
    assert log.current() == state
