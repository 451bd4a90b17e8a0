"""The conversation trie against one built from whole sequences in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from gristmill.llm import trie
from gristmill.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, a double"


def by_hand(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members, leaves_of = defaultdict(list), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            members[built[:d]].append((c, len(built) == d))
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, found in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(found) - 1) * len(node[-1][1].encode().split()) if node else 0
            leaves[node[:d]] += not children[node]
    rows = set()
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, end in found if end))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        rows.add((
            min(c for c, _ in found), len(node), parent, len(found), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return rows, leaves_of


NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "k", 0.5) for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in prefix_trie(df).select(*NAMES).collect()]
    assert len(got) == len(set(got))
    return set(got)


def drawn(seed, convs, texts):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, turn if turn else None, rng.choice(["user", "bot", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    few = ["hi", "hi there you", None, "", "x  y\tz"]
    rows = drawn(seed, [*range(0, 130), -7, -20, -45, 10**12, 10**12 + 3], few)
    assert found(spark, rows) == by_hand(rows)[0]


def test_many_copies_and_a_long_one(spark):
    """One conversation many times over, and one so long that it lies in several tasks, twice."""
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 400) for t in range(5)]
    rows += [(c, t, "bot", f"word {t % 50}") for c in (1_000, 1_020) for t in range(1_500)]
    rows += [(c, 0, "user", "alone") for c in (2_001, 2_002, 2_003)]
    assert found(spark, rows, 8) == by_hand(rows)[0]


def test_lists_over_several_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "LIST_BYTES", 40)
    monkeypatch.setattr(trie, "HOT_KEYS", 3)
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 90) for t in range(4)]
    assert found(spark, rows) == by_hand(rows)[0]


def test_a_crowded_screen_changes_nothing(spark, monkeypatch):
    from gristmill.llm import screens

    monkeypatch.setattr(screens, "bits_for", lambda n: screens.PAGE)
    rows = drawn(9, range(300), [f"text {i}" for i in range(40)])
    assert found(spark, rows) == by_hand(rows)[0]


def test_nothing_and_no_identifier(spark):
    assert found(spark, []) == set()
    rows = [(None, 0, "user", "lost"), (3, None, None, None)]
    assert found(spark, rows) == by_hand(rows)[0]


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(c, 1, r, t) for c in range(40) for r, t in (("a", "x"), ("b", "y"), ("a", "x"), (None, "z"))]
    assert found(spark, rows) == found(spark, rows[::-1], 1)
