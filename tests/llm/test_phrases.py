"""Collocations against a count of everything in plain Python."""

import re
import tracemalloc
from collections import Counter

import pyarrow as pa

from gristmill.llm import phrases as op
from gristmill.llm.phrases import collocations
from gristmill.llm.screens import PAGE, ROWS, Screen, bits_for, screen

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, top, longest=4):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, longer), f in candidates.items():
        for n in range(2, len(longer)):
            for i in range(len(longer) - n + 1):
                part = lang, longer[i : i + n]
                if 100 * f >= 80 * candidates[part]:
                    covered.add(part)
    out = {}
    for (lang, words), a in candidates.items():
        if (lang, words) in covered:
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, k = min((2_000_000 * a // (lf + r), k) for k, (lf, r) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), *cuts[k]))
    rows = set()
    for lang, found in out.items():
        for rank, (score, a, phrase, lf, r) in enumerate(sorted(found)[:top], 1):
            rows.add((lang, rank, phrase.decode(), -a, lf, r, totals[lang], -score))
    return rows


def test_against_counting_all(spark):
    mixed = ["New York City, new york", "the big\tapple! The BIG apple", "a b c d e f. a b c d e", "Ä ä  Ä ä", None, ""]
    rows = [("en", t) for t in mixed * 7] + [(None, t) for t in mixed * 4] + [("und", "new york")] * 3
    rows += [("de", " ".join(["x", "y"] * 40)), ("de", "a\x0bb\x0cc\rd\x01 e")] + [("fr", "x" * 9_000 + " y")] * 6
    rows += [("it", ".;:!?,")] * 3
    docs = spark.createDataFrame([(i, t, g, i, "p") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, f int, phrase string")
    for least, top in ((3, 100), (5, 3), (1, 10_000)):
        got = {tuple(r) for r in collocations(docs, least=least, top=top).collect()}
        assert got == by_hand(rows, least, top)


def test_nasty_and_empty(spark, nasty, texts, nothing):
    from pyspark.sql import functions as F

    named = nasty.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en"))
    rows = [("en" if i % 3 == 0 else None, t) for i, t in enumerate(texts)]
    assert {tuple(r) for r in collocations(named, least=4).collect()} == by_hand(rows, 4, 2_000)
    assert collocations(nothing.withColumn("lang", F.lit("en"))).count() == 0


def test_large_counts_stay_exact(spark):
    """Scores are worked out beyond 64 bits."""
    from pyspark.sql import functions as F

    value = spark.sql("select cast(2000000 as decimal(20,0)) * cast(9000000000000000 as decimal(18,0)) div cast(18000000000000001 as decimal(20,0)) as score")
    assert value.first()["score"] == 2_000_000 * 9_000_000_000_000_000 // 18_000_000_000_000_001
    assert value.select(F.col("score")).dtypes[0][1] == "bigint"


def test_screen_never_loses_a_repeated_hash(spark):
    numbers = [(i * i + 1,) for i in range(4_000)] + [(i * i + 1,) for i in range(0, 4_000, 7)] + [(None,)]
    table = spark.createDataFrame(numbers, "h long")
    import numpy as np

    once = np.array([i * i + 1 for i in range(4_000)], dtype=np.uint64)
    twice = screen(table, "h", len(numbers), 2).passes(once)
    assert twice[::7].all() and twice.mean() < 0.25
    assert screen(table, "h", len(numbers), 1).passes(once).all()
    # Far too small for its hashes, it lets more pass and loses none.
    assert screen(table, "h", 1, 2).passes(once)[::7].all()
    assert bits_for(1) == PAGE and bits_for(10**15) == 1 << 27 and ROWS == 2


def test_words_of_a_block_take_little_memory():
    """A block of all languages was one list of its words, 16.6 times the bytes here."""
    text = b" ".join(b"word%d" % (i * 7 % 5_003) for i in range(300_000))
    few = Screen(PAGE, {})
    tracemalloc.start()
    block = op.Coded(text, "en", few)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(block.ids) == 300_000 and len(block.words) == 5_003
    # Ids, hashes and flags of all words, and one part of the text as words.
    assert most < 12 * len(text)
    tracemalloc.start()
    columns = [pa.array(["en", "de"]), pa.array([text, text], type=pa.binary())]
    held = next(op.blocks(iter([pa.RecordBatch.from_arrays(columns, names=["lang", "text"])])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == {"en": text, "de": text} and most < 5 * len(text)


def test_parts_of_a_text_have_its_tokens(monkeypatch):
    text = "New York.City,  a\tb!\nc ,. Ä\u00a0ä d\x0be ".encode() * 5
    for size in (1, 2, 7, 64, 10_000):
        monkeypatch.setattr(op, "PART_BYTES", size)
        parts = list(op.parts_of(text))
        assert b"".join(parts) == text and [w for p in parts for w in op.tokens(p)] == op.tokens(text)
    assert list(op.parts_of(b"")) == []


def test_a_screen_takes_one_worker_a_task(spark, monkeypatch):
    """Words were hashed in one Python worker and packed in another, and both stayed."""
    frames = type(spark.range(1))
    chained, plain = [], frames.mapInArrow

    def counted(self, *args, **kwargs):
        chained.append(self._jdf.queryExecution().analyzed().toString().count("MapInArrow"))
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(frames, "mapInArrow", counted)
    words = spark.createDataFrame([("en", "new", 40), ("de", "neu", 31), ("en", "york", 30)], "lang string, phrase string, f long")
    found = op.hashed_words(words)
    assert found.passes(op.word_hashes(pa.array([b"new", b"york"]), "en")).all()
    assert found.passes(op.word_hashes(pa.array([b"neu"]), "de")).all()
    # The bitmaps are made behind a shuffle, in a stage of their own.
    assert chained == [0, 1]
