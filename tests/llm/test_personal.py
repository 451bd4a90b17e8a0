import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import personal as op

letters = st.text(alphabet="a1.@+- ()0%_-é9\n2", max_size=60)
digits = st.text(alphabet="0123456789 -.", max_size=80)


@settings(max_examples=2_000, deadline=None)
@given(letters | digits)
def test_plain_spans_are_those_of_the_patterns(text):
    assert op.personal_spans(text)[0] == op.brute_force(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("mail john at example dot com", "email", "john at example dot com"),
        ("é john[AT]mail.example.com!", "email", "john[AT]mail.example.com"),
        ("jоhn@exаmple.com here", "email", "jоhn@exаmple.com"),
        ("ring plus one two three four five six seven eight nine", "phone",
         "plus one two three four five six seven eight nine"),
        ("card ４１１１ 1111 1111 １１１１.", "card", "４１１１ 1111 1111 １１１１"),
        ("four " + "one " * 14 + "one", "card", "four " + "one " * 14 + "one"),
        ("at 10 dot 0 dot 0 dot 1 x", "ip", "10 dot 0 dot 0 dot 1"),
        ("call plus 44 20 7946 0958 now", "phone", "plus 44 20 7946 0958"),
        ("PLUS-44 20 7946 0958", "phone", "PLUS-44 20 7946 0958"),
        ("10\tdot\t0\tdot\t0\tdot\t1", "ip", "10\tdot\t0\tdot\t0\tdot\t1"),
        ("10  dot  0  dot  0  dot  1", "ip", "10  dot  0  dot  0  dot  1"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    plain, added = op.personal_spans(text)
    assert plain == [] and [(k, text[i:j]) for k, i, j in added] == [(kind, found)]


@pytest.mark.parametrize(
    "text", ["We met at noon dot.", "one two three", "look at this (at last)", "Ünïcödé ½ x²", "he was at the dots"]
)
def test_clean_texts_stay_clean(text):
    assert op.personal_spans(text) == ([], [])


def test_plain_spans_stay_beside_disguised_ones():
    text = "a@b.co and c (at) d (dot) org"
    plain, added = op.personal_spans(text)
    assert plain == [("email", 0, 6)] and [text[i:j] for _, i, j in added] == ["c (at) d (dot) org"]


signs = ["plus", " ", "  ", "-", "\t", "4", "44 20 7946 0958", "10", "dot", "at", "one", "two", "(", ")", "[at]", ".", "@", "a", "b.co", ",", "é"]


@settings(max_examples=2_000, deadline=None)
@given(st.lists(st.sampled_from(signs), max_size=25).map("".join))
def test_the_gate_skips_only_what_stays_the_same(text):
    gated, free = op.normalised(text), op.normalised(text, gate=False)
    assert (free.text if gated is None else gated.text) == free.text
    assert gated is not None or free.text == text


def test_long_runs_of_blanks_take_linear_time():
    for text in (" " * 200_000, "plus 4" + " " * 200_000, "( " * 100_000, "1 " + "\t" * 200_000 + "dot 1"):
        op.personal_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@" * 500, "1" * 200_000, "1 " * 100_000, "a." * 100_000, "+1" + "." * 100_000):
        op.personal_spans(text)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{i}:{j}" for k, i, j in spans).encode()).hexdigest()


def test_whole_table(documents, corpus):
    got = {r["doc_id"]: r for r in op.personal_report(documents).collect()}
    assert set(got) == set(corpus)
    for doc, text in corpus.items():
        spans = op.brute_force(text)
        counts = [sum(k == kind for k, _, _ in spans) for kind in op.KINDS]
        r = got[doc]
        assert [r[f"n_{k}"] for k in op.KINDS] == counts and r["base_sha256"] == digest(spans)
        assert set(f"{k}:{i}:{j}" for k, i, j in spans) <= set(r["spans"].split(","))


def test_odd_rows(nasty, nothing, repeated, texts):
    assert op.personal_report(nasty).count() == len(texts)
    assert op.personal_report(nothing).collect() == []
    assert {r["spans"] for r in op.personal_report(repeated).collect()} == {""}
