import sys

import numpy as np
import pandas as pd
import pytest

from gristmill.llm import substring as op


def rows(df):
    return sorted(tuple(r)[:4] for r in op.substring_report(df).collect())


def test_cover_meets_every_shift():
    for shift in range(op.PERIOD):
        assert any((c + shift) % op.PERIOD in op.COVER for c in op.COVER)


def test_whole_table_against_every_window(documents, corpus):
    want = sorted((d, *v) for d, v in op.brute_force(corpus).items())
    assert rows(documents) == want


def test_small_chunks_and_odd_rows(nasty, texts, monkeypatch):
    monkeypatch.setattr(op, "CHUNK_BYTES", 2_000)
    want = sorted((d, *v) for d, v in op.brute_force(dict(enumerate(texts))).items())
    assert rows(nasty) == want


@pytest.mark.parametrize("width", [21, 22, 40])
def test_other_widths(nasty, texts, width):
    got = {r["doc_id"]: r["n_removed"] for r in op.repeated_passages(nasty, width).collect()}
    assert got == {d: v[1] for d, v in op.brute_force(dict(enumerate(texts)), width).items()}


def test_width_below_the_period_is_refused(nasty):
    with pytest.raises(ValueError, match="21"):
        op.repeated_passages(nasty, 20)


def test_empty_and_repeated(nothing, repeated):
    assert rows(nothing) == []
    got = op.repeated_passages(repeated).collect()
    held = repeated.collect()
    want = op.brute_force({i: r["text"] for i, r in enumerate(held)})
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in got), key=key) == sorted(
        ((r["doc_id"], *want[i][:2]) for i, r in enumerate(held)), key=key
    )


def test_spans_name_what_is_gone(nasty, texts):
    for r in op.repeated_passages(nasty).collect():
        words = (texts[r["doc_id"]] or "").split()
        gone = np.zeros(len(words), bool)
        for i, j in r["spans"]:
            gone[i:j] = True
        assert " ".join(w for w, g in zip(words, gone, strict=True) if not g).encode() == bytes(r["kept"])


def test_words_and_hashes_of_odd_texts(texts):
    """Words as ``split`` has them; hashes are equal where words are, and nowhere else."""
    odd = [None, b"", b" \t", b"a\x1cb\x85c\xa0d \x0be\x00 \x00 \x00\x00", b"x" * 64 + b" " + b"x" * 65 + b"\n" + b"x" * 66]
    odd += [b" ".join(b"abcdefghijklmnopqrstuvwxyz"[:n] for n in range(1, 27)), b" lead", b"trail ", b"z" * 9_000]
    odd += [t.encode() if t is not None else None for t in texts] + [None]
    words, hashes, starts = op.listed_words(odd)
    want = [(t or b"").split() for t in odd]
    flat = [w for ws in want for w in ws]
    assert words.to_pylist() == flat and np.diff(starts).tolist() == [len(ws) for ws in want]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    for none in ([], [None], [b"  ", b""]):
        words, hashes, starts = op.listed_words(none)
        assert len(words) == len(hashes) == 0 and starts.tolist() == [0] * (len(none) + 1)


def test_words_of_a_chunk_are_no_python_objects():
    """Each word of a chunk was a Python object three times over, which took most of the CPU."""
    rows = pd.DataFrame({"doc_id": range(50), "data": [b" ".join(b"word%d" % i for i in range(2_000))] * 50})
    before = sys.getallocatedblocks()
    chunk = op.Chunk.of(rows)
    assert len(chunk.hashes) == 100_000 and sys.getallocatedblocks() - before < 10_000


def test_equal_first_halves_are_told_apart():
    high = np.array([7, 3, 7, 3, 7, 9], dtype=np.uint64)
    low = np.array([1, 4, 2, 4, 1, 0], dtype=np.uint32)
    found = op.Distinct.of(high, low)
    assert list(zip(found.high.tolist(), found.low.tolist(), strict=True)) == [(3, 4), (7, 1), (7, 2), (9, 0)]
    assert found.entry.tolist() == [1, 0, 2, 0, 1, 3] and found.several.tolist() == [True, True, False, False]


def test_passages_up_to_the_ends_of_documents():
    """Covered words that meet at a border between documents are two spans."""
    data = [b"a b c", None, b"d e f", b"", b"g h i"]
    chunk = op.Chunk.of(pd.DataFrame({"doc_id": range(5), "data": data}))
    got = op.without_passages(chunk, np.array([1, 3, 4, 7]), 2)
    assert got["spans"] == [[[1, 3]], [], [[0, 3]], [], [[1, 3]]]
    assert got["kept"] == [b"a", b"", b"", b"", b"g"] and list(got["n_removed"]) == [2, 0, 3, 0, 2]
