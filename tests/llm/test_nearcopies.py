import numpy as np
import pytest

from gristmill.llm import nearcopies as op
from gristmill.llm.components import components


def rows(df):
    return {r[0]: tuple(r)[1:] for r in op.near_copies(df).collect()}


def test_whole_table_against_all_pairs(documents, corpus):
    assert rows(documents) == op.brute_force(corpus)


@pytest.mark.parametrize("block", [2, 1_500])
def test_odd_rows(nasty, texts, block, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "FAMILY", block)
    assert rows(nasty) == op.brute_force(dict(enumerate(texts)))


def test_chains_and_near_misses(spark):
    """A chain whose ends are far apart, and pairs on either side of the threshold."""
    base = [f"a{i}" for i in range(100)]
    texts, words = {}, list(base)
    for i in range(30):
        texts[i] = " ".join(words)
        words[(3 * i) % 100] = f"c{i}"
    for i in range(40):
        other = [f"b{j}" for j in range(64)]
        for k in range(i % 6):
            other[5 + 10 * k] = f"d{i}_{k}"
        texts[100 + i] = " ".join(other)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert rows(df) == op.brute_force(texts)


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(2)
    for errors in (0, 1, op.DISTANCE):
        a = rng.integers(0, 2**16, op.SYMBOLS).astype(np.uint64)
        b = a.copy()
        b[rng.choice(op.SYMBOLS, errors, replace=False)] += 1
        keys = op.chunk_keys(np.stack([a, b]))
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_empty_and_repeated(nothing, repeated):
    assert op.near_copies(nothing).collect() == []
    got = op.near_copies(repeated).collect()
    held = {r["doc_id"]: r["text"] for r in repeated.collect() if r["doc_id"] is not None}
    want = op.brute_force(held)
    assert len(got) == repeated.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]
    assert sum(r["doc_id"] is None and r["component_id"] == want[8][1] for r in got) == 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(130, 101), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 131)}
    none = components(spark.createDataFrame([], "u long, v long"))
    assert none.collect() == []
