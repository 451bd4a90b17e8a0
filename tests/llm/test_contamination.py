import numpy as np
import pytest

from gristmill.llm import contamination as op


@pytest.fixture(scope="module")
def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def rows(df):
    return {r[0]: tuple(r)[1:] for r in op.contamination_report(*df).collect()}


def test_winnow_shares_a_print_in_every_shared_run():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 2**63, op.WINDOW).astype(np.uint64)
        pads = [rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64) for _ in range(4)]
        prints = [
            set(g[op.winnow(g)].tolist())
            for g in (np.concatenate([pads[0], shared, pads[1]]), np.concatenate([pads[2], shared, pads[3]]))
        ]
        assert prints[0] & prints[1]


def test_whole_table_against_every_window(documents, benchmark, corpus):
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    assert rows((documents, benchmark)) == op.brute_force(corpus, items)


@pytest.mark.parametrize("index_bytes", [1 << 22, 0])
def test_both_ways_with_short_and_odd_items(spark, nasty, texts, index_bytes):
    items = {1: texts[8], 2: "alpha beta", 3: "iota", 4: "", 5: None, 6: texts[26], 7: "Kappa; GAMMA theta"}
    table = spark.createDataFrame([*items.items(), (None, "eta"), (2, "alpha beta")], "item_id long, text string")
    want = op.brute_force(dict(enumerate(texts)), items)
    got = op.contaminated(nasty, table, index_bytes=index_bytes).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in got} == {
        d: v[:3] for d, v in want.items()
    }


@pytest.mark.parametrize("index_bytes", [1 << 22, 0])
def test_empty_tables(nothing, nasty, texts, index_bytes):
    none = nothing.selectExpr("doc_id AS item_id", "text")
    assert op.contaminated(nothing, none, index_bytes=index_bytes).collect() == []
    got = op.contaminated(nasty, none, index_bytes=index_bytes).collect()
    assert len(got) == len(texts) and not any(r["n_hit"] for r in got)


@pytest.mark.parametrize("index_bytes", [1 << 22, 0])
def test_repeated_rows(spark, repeated, texts, index_bytes):
    table = spark.createDataFrame([(1, texts[8])], "item_id long, text string")
    got = op.contaminated(repeated, table, index_bytes=index_bytes).collect()
    want = op.brute_force({i: r["text"] for i, r in enumerate(repeated.collect())}, {1: texts[8]})
    assert sorted(r["n_hit"] for r in got) == sorted(v[1] for v in want.values())
