import tracemalloc
import zlib

import numpy as np

from gristmill.llm import toxicity as op


def test_held_out_rows_are_told_apart(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = op.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_labels_teach_nothing(spark, nasty):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, i % 2) for i in held], "doc_id long, toxic int")
    machine = op.learnt(nasty, labels)
    assert not len(machine.terms)


def test_pairs_are_learnt(spark):
    """Neither word alone is toxic, both together are."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(4_000):
        words = [f"w{i}" for i in rng.integers(0, 200, 10)]
        a, b = rng.random(2) < 0.5
        rows.append((i, " ".join(words + ["insult"] * int(a) + ["group"] * int(b))))
        labels.append((i, int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = op.learnt(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = machine.scores([b"insult w1 w2", b"group w1 w2", b"insult w1 group w2", b"w1 w2"])
    assert score[2] > 0.5 and max(score[[0, 1, 3]]) < 0.5


def test_odd_rows(spark, nasty, nothing, repeated, texts):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (10**9, 0)], "doc_id long, toxic int")
    got = op.toxicity(nasty, labels).collect()
    assert len(got) == len(texts)
    assert op.toxicity(nothing, labels).collect() == []
    none = labels.where("false")
    assert {r["predicted"] for r in op.toxicity(repeated, none).collect()} == {0}
    assert op.toxicity(repeated, labels).count() == repeated.count()
    assert [r["held_out"] for r in op.toxicity(repeated, none).collect() if r["doc_id"] is None] == [True] * 3


def test_terms_of_a_block_take_little_memory():
    """A block took 17 times its bytes in lists of words and copies of repeated terms."""
    rng = np.random.default_rng(0)
    texts = [b" ".join(b"word%d" % i for i in rng.integers(0, 5_000, 300)) for _ in range(1_500)]
    op.WORD_TERMS.update((b"word%d" % i, op.hashed_terms(b"word%d" % i)) for i in range(5_000))
    tracemalloc.start()
    text, term = op.distinct_terms([*texts, None, b"", b"a a a"])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5 * sum(map(len, texts))
    assert (np.diff(text.astype(np.int64) << 32 | term) > 0).all()
    assert text[-1] == len(texts) + 2 and len(texts) not in text
    some = op.known_terms(np.unique(term)[::2])
    place = op.distinct_terms(texts, some)
    held = some[term] & (text < len(texts))
    assert np.array_equal(place[0], text[held]) and np.array_equal(place[1], term[held])
