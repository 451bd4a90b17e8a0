"""Collocations: phrases whose words stand together more often than their parts do.

Counts are found level by level. Words are counted first; pairs are looked at only where both
words are frequent, longer phrases only where every pair in them may be. What passes the screens
is counted exactly, by its text. Screens hold bits of hashed counts and never lose a frequent one.

Estimation works on streams of counts in sorted order. In prefix order a phrase meets the phrase
without its last word, in suffix order the one without its first: merge joins of sorted streams
hand down the counts of all first parts and of all last parts, and the largest count of a phrase
one word longer on either side. Each level reads the annotated stream of the level below it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import (
    MULTIPLIER,
    give_back,
    mix,
    ship_package,
    small_batches,
    staged,
    text_bytes,
)
from gristmill.llm.screens import Screen, screen

LONGEST = 4
LEAST = 30
COVERED = 80
SCALE = 2_000_000
TOP = 2_000
NO_LANGUAGE = "und"

# Bytes of text that a task counts at a time, and that are a list of words at a time.
BLOCK_BYTES, PART_BYTES = 6 << 20, 1 << 18

# Rows of counts that go back to Spark at a time.
ROWS_BACK = 1 << 14

# Ends of pieces become a full stop, A-Z lower case; tabs and blanks part words.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
PIECES = bytes(0x2E if b in ENDS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BETWEEN = re.compile(b"[\x20\x09" + ENDS + b"]")


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, with a full stop between pieces."""
    return text.translate(PIECES).replace(b".", b" . ").split()


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``PART_BYTES``, cut between words; their tokens are those of the text."""
    first = 0
    while first < len(text):
        cut = BETWEEN.search(text, first + PART_BYTES)
        last = cut.start() if cut else len(text)
        yield text[first:last]
        first = last


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, bytes]]:
    """Texts by language, a bounded amount at a time, with a full stop between them."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            if not (text := text.as_py()):
                continue
            held.setdefault(lang.as_py(), []).append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield {k: b".".join(v) for k, v in held.items()}
                held, size = {}, 0
    if held:
        yield {k: b".".join(v) for k, v in held.items()}


def language_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """A hash of every word of a list, told apart by language."""
    plain = np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64)
    return mix(plain ^ language_seed(lang))


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * MULTIPLIER + hashes[1:])


class Coded:
    """The tokens of a block in one language: local numbers, and which words may be frequent.

    Only the words of one part are Python objects at a time; the block has a number for each.
    """

    def __init__(self, text: bytes, lang: str, words: Screen):
        listed = pa.chunked_array(
            [pa.array(tokens(part), type=pa.binary()).dictionary_encode() for part in parts_of(text)]
        ).unify_dictionaries()
        self.words = listed.chunk(0).dictionary
        self.ids = np.concatenate([part.indices.to_numpy() for part in listed.chunks]).astype(np.int64)
        own = word_hashes(self.words, lang)
        good = words.passes(own)
        good[np.array([w == b"." for w in self.words.to_pylist()], dtype=bool)] = False
        self.hashes, good = own[self.ids], good[self.ids]
        self.pair_at = good[:-1] & good[1:]


def mapped(docs: DataFrame, schema: str, work: Callable) -> DataFrame:
    """Apply ``work(language, text)``, which gives lists of columns, to blocks of text."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for lang, text in block.items():
                for columns in work(lang, text):
                    counted = pa.RecordBatch.from_arrays(columns, names=names)
                    yield from (counted.slice(i, ROWS_BACK) for i in range(0, counted.num_rows, ROWS_BACK))
        give_back()

    small_batches(docs.sparkSession)
    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def same(value: str, n: int) -> pa.Array:
    return pa.array([value], type=pa.string()).take(pa.array(np.zeros(n, dtype=np.int32)))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, phrase, f`` of every word; ``docs`` has ``lang`` and the text's bytes."""

    def work(lang: str, text: bytes) -> Iterator[list]:
        counts = Counter()
        for part in parts_of(text):
            counts.update(tokens(part))
        counts.pop(b".", None)
        yield [
            same(lang, len(counts)),
            pa.array(list(counts), type=pa.binary()).cast(pa.string()),
            pa.array(list(counts.values()), type=pa.int64()),
        ]

    counted = mapped(docs, "lang string, phrase string, f long", work)
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def pair_counts(docs: DataFrame, words: Screen) -> DataFrame:
    """``pair, f``: hashes of pairs of words that may be frequent, with the sum of their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def work(lang: str, text: bytes) -> Iterator[list]:
        block = Coded(text, lang, sent.value)
        pairs, counts = np.unique(pair_hashes(block.hashes)[block.pair_at], return_counts=True)
        yield [pa.array(pairs.view(np.int64)), pa.array(counts.astype(np.int64))]

    return mapped(docs, "pair long, f long", work).groupBy("pair").agg(F.sum("f").alias("f"))


def long_counts(docs: DataFrame, words: Screen, pairs: Screen, longest: int) -> DataFrame:
    """``lang, n, phrase, f``: exact counts of phrases in which every pair passes its screen."""
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def work(lang: str, text: bytes) -> Iterator[list]:
        frequent, paired = sent.value
        block = Coded(text, lang, frequent)
        at = np.nonzero(block.pair_at)[0]
        at = at[paired.passes(pair_hashes(block.hashes)[at])]
        ids, names = block.ids, block.words.cast(pa.string())
        # Numbers of the phrases that start at each position: exact, as they code (phrase, next word).
        good = np.zeros(len(ids) + 1, dtype=bool)
        good[at] = True
        number = ids.copy()
        for n in range(2, longest + 1):
            if not len(at):
                return
            codes, first, inverse, counts = np.unique(
                (number[at] << 32) | ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True
            )
            number[at] = inverse
            places = at[first]
            del codes, first, inverse
            for i in range(0, len(places), ROWS_BACK):
                some = places[i : i + ROWS_BACK]
                parts = [names.take(pa.array(ids[some + k])) for k in range(n)]
                yield [
                    same(lang, len(some)),
                    pa.array(np.full(len(some), n, dtype=np.int32)),
                    pc.binary_join_element_wise(*parts, " "),
                    pa.array(counts[i : i + ROWS_BACK].astype(np.int64)),
                ]
            # One word more: the pair that it ends has to pass as well.
            at = at[good[at + n - 1]]

    counted = mapped(docs, "lang string, n int, phrase string, f long", work)
    return counted.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))


def without_last(phrase: str = "phrase") -> F.Column:
    return F.expr(f"substring({phrase}, 1, length({phrase}) - instr(reverse({phrase}), ' '))")


def without_first(phrase: str = "phrase") -> F.Column:
    return F.expr(f"substring({phrase}, instr({phrase}, ' ') + 1)")


def met(stream: DataFrame, below: DataFrame, part: F.Column, counts: F.Column) -> DataFrame:
    """Merge a stream with the level below it, both in the order of the shared part."""
    other = below.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"), "parts")
    pairs = stream.withColumn("part", part).join(other.hint("merge"), ["lang", "part"])
    return pairs.select("lang", "phrase", "f", counts.alias("parts"))


def estimated(grams: dict[int, DataFrame]) -> DataFrame:
    """Candidates with the counts ``lefts`` and ``rights`` of their parts at every cut."""
    none = F.expr("cast(array() as array<bigint>)")
    lefts = rights = grams[1].withColumn("parts", none)
    out = None
    for n in range(2, max(grams) + 1):
        lefts = met(grams[n], lefts, without_last(), F.concat("parts", F.array("part_f")))
        rights = met(grams[n], rights, without_first(), F.concat(F.array("part_f"), "parts"))
        level = lefts.withColumnRenamed("parts", "lefts").join(
            rights.select("lang", "phrase", F.col("parts").alias("rights")).hint("merge"), ["lang", "phrase"]
        )
        out = level if out is None else out.unionByName(level)
    return out


def extensions(longer: DataFrame) -> DataFrame:
    """For each phrase the largest count ``longer_f`` of a candidate one word longer on either side."""
    ends = [longer.select("lang", part.alias("phrase"), "f") for part in (without_last(), without_first())]
    return ends[0].unionByName(ends[1]).groupBy("lang", "phrase").agg(F.max("f").alias("longer_f"))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP
) -> DataFrame:
    """The best phrases of each language with their counts and scores.

    ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: no words); other columns are ignored.
    A-Z count as lower case. Phrases of 2 to ``longest`` words that occur ``least`` times are
    candidates; a cut into two parts gives ``SCALE * a / (l + r)``, and the lowest cut counts. A
    candidate inside a longer one with ``covered`` percent of its count goes. As counts fall with
    length, looking one word further is enough. Returns ``lang, rank, phrase, a, l, r, n, score``;
    a language without candidates, and an empty table, gives no row. Repeated rows count each time.
    """
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), text_bytes().alias("text"))
    words = staged(word_counts(texts), "words")
    frequent = words.where(F.col("f") >= least)
    first = hashed_words(frequent)
    pairs = staged(pair_counts(texts, first).where(F.col("f") >= least), "pairs")
    second = screen(pairs, "pair", pairs.count(), 1)
    longer = staged(long_counts(texts, first, second, longest).where(F.col("f") >= least), "phrases")

    grams = {1: frequent} | {n: longer.where(F.col("n") == n).drop("n") for n in range(2, longest + 1)}
    cuts = F.expr(
        "array_min(transform(lefts, (l, i) -> struct("
        f"cast({SCALE} as decimal(20, 0)) * cast(f as decimal(18, 0)) div cast(l + rights[i] as decimal(20, 0))"
        " as score, i as cut, l as l, rights[i] as r)))"
    )
    scored = estimated(grams).withColumn("best", cuts)
    inside = extensions(longer.where("n > 2"))
    kept = scored.join(inside.hint("merge"), ["lang", "phrase"], "left").where(
        F.col("longer_f").isNull() | (100 * F.col("longer_f") < covered * F.col("f"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (
        kept.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def hashed_words(frequent: DataFrame) -> Screen:
    """A screen of the frequent words."""

    def hashed(batch: pa.RecordBatch) -> np.ndarray:
        by_lang = {}
        for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(word.encode())
        return np.concatenate([word_hashes(pa.array(w, type=pa.binary()), lang) for lang, w in by_lang.items()])

    return screen(frequent, ["lang", "phrase"], frequent.count(), 1, hashed)


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
    unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
listed AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces),
sized AS (SELECT lang, words, unnest(range(1, {LONGEST + 1})) AS k FROM listed),
placed AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM sized WHERE len(words) >= k),
grams AS (
  SELECT lang, k, words[i : i + k - 1] AS words, count(*) AS f FROM placed GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM grams WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT lang, k, words, f, unnest(range(1, k)) AS cut FROM candidates),
scores AS (
  SELECT c.lang, c.k, c.words, c.f, c.cut, l.f AS l, r.f AS r,
    ({SCALE}::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score
  FROM cuts c
  JOIN grams l ON l.lang = c.lang AND l.k = c.cut AND l.words = c.words[1 : c.cut]
  JOIN grams r ON r.lang = c.lang AND r.k = c.k - c.cut AND r.words = c.words[c.cut + 1 :]),
best AS (
  SELECT * FROM scores
  QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, f, words, k, unnest(range(2, k)) AS size FROM candidates),
inner_placed AS (
  SELECT lang, f, words, size, unnest(range(1, k - size + 2)) AS i FROM inner_parts),
inside AS (
  SELECT lang, words[i : i + size - 1] AS words, max(f) AS longer_f FROM inner_placed GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.words = b.words
  WHERE s.longer_f IS NULL OR 100 * s.longer_f < {COVERED} * b.f),
ranked AS (
  SELECT *, array_to_string(words, ' ') AS phrase,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, array_to_string(words, ' ')) AS rank
  FROM kept)
SELECT lang, rank, phrase, f AS a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
