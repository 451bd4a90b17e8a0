import hashlib
from collections import defaultdict

import pytest
from compare import compare, connect

from gristmill.llm import exact as op


def squeezed(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_agrees_with_sql(spark, sf_dir):
    run = lambda s, d: op.exact_copies(s.read.parquet(f"{d}/documents.parquet"))
    assert compare(spark, connect(sf_dir), run, op.SQL, sf_dir) is None


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_odd_rows_and_fans(nasty, texts, fan):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[squeezed(t)].append((-len(t or ""), i))
    want = {}
    for text, members in groups.items():
        keep = min(members)[1]
        digest = hashlib.sha256(text.encode()).hexdigest()
        want |= {i: (i, keep, len(members), i == keep, digest) for _, i in members}
    got = {r["doc_id"]: tuple(r) for r in op.exact_copies(nasty, fan=fan).collect()}
    assert got == want


def test_empty_and_bad_fan(nothing, nasty):
    assert op.exact_copies(nothing).collect() == []
    with pytest.raises(ValueError, match="pairs"):
        op.exact_copies(nasty, fan=1)


def test_repeated_rows_stay_once(repeated):
    kept = op.drop_copies(repeated).collect()
    assert len({squeezed(r["text"]) for r in kept}) == len(kept)
    assert {squeezed(r["text"]) for r in kept} == {squeezed(r["text"]) for r in repeated.collect()}
    verdict = op.exact_copies(repeated).collect()
    assert sum(r["doc_id"] is None and r["text_sha256"] == hashlib.sha256(b"").hexdigest() for r in verdict) == 1
    assert all(r["keep_id"] is not None for r in verdict if r["group_size"] > 1)


def test_rows_that_share_an_identifier_are_not_copies(spark):
    """Texts without an identifier and under one identifier all stay beside a row that comes twice."""
    rows = [(None, "one"), (None, "two"), (7, "three"), (7, "four"), (8, "again"), (8, "again")]
    rows += [(9, "sp aced"), (9, "spaced"), (9, "s paced"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], squeezed(r["text"]), len(r["text"] or "")) for r in op.drop_copies(df).collect()]
    assert sorted(kept, key=str) == sorted(
        [(None, "one", 3), (None, "two", 3), (7, "three", 5), (7, "four", 4), (8, "again", 5),
         (9, "spaced", 7), (None, "", 0)], key=str
    )
