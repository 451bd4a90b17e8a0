import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from gristmill.llm import packing as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return op.Encoder.of(PATH)


def ids_of(encoder, text):
    return np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, op.END], dtype="<u4")


def check_all(rows, texts, encoder, capacity=op.CAPACITY):
    """Every id in exactly one piece, sequences gapless and within the capacity."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids, at = ids_of(encoder, text), 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences)


def test_whole_table(documents, corpus, encoder):
    rows = op.pack(documents, PATH).collect()
    used = check_all(rows, corpus, encoder)
    assert used <= sum(r["length"] for r in rows) / op.CAPACITY * 1.02 + 1


def test_odd_rows(nasty, texts, encoder, nothing):
    check_all(op.pack(nasty, PATH, group_pieces=20).collect(), dict(enumerate(texts)), encoder)
    check_all(op.pack(nasty, PATH, capacity=64, small=(8, 4)).collect(), dict(enumerate(texts)), encoder, 64)
    assert op.pack(nothing, PATH).collect() == []


def test_repeated_rows_are_packed_as_often(repeated, encoder):
    rows = op.pack(repeated, PATH).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(encoder, r["text"])) for r in repeated.collect())
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_ranks_and_merges_give_the_same_ids(encoder):
    rng = random.Random(3)
    letters = " \n\nabthe'sé12½²ñÑ.,-ªºth<|ж　\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3_000)]
    texts += ["", " ", "a  b", "x <|endoftext|> y", "y" * 3_000, "don't we're", "a\x1cb", "a\xa0 b"]
    for t in texts:
        assert encoder.encode(t).tolist() == ids_of(encoder, t)[:-1].tolist()


def test_differencing_balances_and_keeps_all():
    rng = random.Random(5)
    assert op.differenced([], 3) == []
    small = [8, 7, 6, 5, 4]
    assert sorted(sum(small[i] for i in w) for w in op.differenced(small, 2)) == [14, 16]
    for windows in (1, 2, 7, 40):
        sizes = [rng.randint(1, 100) for _ in range(200)]
        out = op.differenced(sizes, windows)
        assert sorted(i for w in out for i in w) == list(range(200))
        sums = [sum(sizes[i] for i in w) for w in out]
        assert len(sums) == windows and max(sums) - min(sums) <= 100
    for _ in range(50):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(0, 60))]
        out = op.packed_group(sizes, 64)
        assert sorted(i for w in out for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 64 for w in out)
