"""Benchmark passages in documents, by winnowed fingerprints.

Of every ``WINDOW`` consecutive hashes of ``GRAM`` words the smallest is a fingerprint, so two
texts that share ``WIDTH = GRAM + WINDOW - 1`` consecutive words share a fingerprint inside them,
and about two hashes in seven are kept. Where a document's fingerprint is also one of a benchmark
item, the windows around it are compared in full. Items shorter than a window are a window of
their own length; for them every run of that length is a fingerprint (a winnow of one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import (
    alphanumeric_words,
    hash_words,
    kept_rows,
    keyed,
    map_rows,
    only,
    starts_of,
    text_bytes,
    window_hashes,
)

WIDTH, GRAM = 10, 5
WINDOW = WIDTH - GRAM + 1

# The benchmark travels to every task only up to so many bytes of text, else it is joined.
INDEX_BYTES = 1 << 22


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash in each run of ``window`` hashes, the last of equal ones."""
    if len(grams) < window:
        return np.zeros(0, dtype=np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(runs)) + window - 1 - runs.argmin(axis=1))


class Texts:
    """Several texts end to end, so that hashing works on long arrays."""

    def __init__(self, texts: list[bytes | None]):
        self.words = [alphanumeric_words(t) for t in texts]
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = starts_of(self.lengths)
        self.hashes = hash_words([w for ws in self.words for w in ws])
        self.text = np.repeat(np.arange(len(texts)), self.lengths)
        self.ends = np.repeat(self.starts[1:], self.lengths)

    def within(self, places: np.ndarray, width: int) -> np.ndarray:
        """Those places from which ``width`` words stay in the same text."""
        places = places[(places >= 0) & (places + width <= len(self.hashes))]
        return places[places + width <= self.ends[places]]

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All runs of ``width`` words: places and hashes."""
        hashes = window_hashes(self.hashes, width)
        places = self.within(np.arange(len(hashes)), width)
        return places, hashes[places]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Winnowed places, and hashes; a winnow that reaches over a text's end is harmless."""
        hashes = window_hashes(self.hashes, GRAM)
        places = self.within(winnow(hashes), GRAM)
        return places, hashes[places]

    def around(self, places: np.ndarray) -> np.ndarray:
        """Starts of the full windows that hold the run of ``GRAM`` words at a place."""
        starts = np.unique((places[:, None] - np.arange(WINDOW)[None, :]).ravel())
        return self.within(starts, WIDTH)

    def run_at(self, place: int, width: int) -> bytes:
        i = place - self.starts[self.text[place]]
        return b" ".join(self.words[self.text[place]][i : i + width])


def item_windows(items: list[tuple]) -> Iterable[tuple[int, bytes, int]]:
    """(length, words, item) for each window of each item."""
    for item, data in items:
        words = alphanumeric_words(data)
        width = min(WIDTH, len(words))
        for i in range(len(words) - width + 1 if width else 0):
            yield width, b" ".join(words[i : i + width]), item


class Index:
    """The benchmark's fingerprints and windows; small enough to be sent to every task."""

    def __init__(self, items: list[tuple]):
        self.windows: dict[bytes, set] = {}
        widths = set()
        for width, words, item in item_windows(items):
            widths.add(width)
            self.windows.setdefault(words, set()).add(item)
        texts = Texts([data for _, data in items])
        self.prints = np.unique(texts.fingerprints()[1])
        self.short = {}
        for width in sorted(widths - {WIDTH}):
            of_width = [w.split() for w in self.windows if w.count(b" ") == width - 1]
            self.short[width] = np.unique([window_hashes(hash_words(w), width)[0] for w in of_width])

    def hits(self, texts: Texts) -> list[tuple[int, int, set]]:
        """(place, length, items) of each window found in the texts."""
        places, hashes = texts.fingerprints()
        starts = texts.around(places[np.isin(hashes, self.prints)]) if len(self.prints) else []
        tried = [(int(p), WIDTH) for p in starts]
        for width, wanted in self.short.items():
            places, hashes = texts.runs(width)
            tried += [(int(p), width) for p in places[np.isin(hashes, wanted)]]
        found = ((p, width, self.windows.get(texts.run_at(p, width))) for p, width in tried)
        return [x for x in found if x[2]]


VERDICT = "doc_id long, n_words long, n_hit long, items array<string>"


def verdicts(ids: list, texts: Texts, hits: Iterable[tuple[int, int, Iterable]]) -> list[tuple]:
    depth = np.zeros(len(texts.hashes) + 1, dtype=np.int64)
    items: list[set] = [set() for _ in ids]
    for place, width, found in hits:
        depth[place] += 1
        depth[place + width] -= 1
        items[texts.text[place]].update(str(i) for i in found)
    covered = starts_of(np.cumsum(depth)[:-1] > 0)
    n_hit = covered[texts.starts[1:]] - covered[texts.starts[:-1]]
    return [
        (doc, int(n), int(h), sorted(i))
        for doc, n, h, i in zip(ids, texts.lengths, n_hit, items, strict=True)
    ]


def judged_by_index(docs: DataFrame, index: Index) -> DataFrame:
    """One pass over the documents; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def work(rows):
        texts = Texts([data for _, data in rows])
        return verdicts([d for d, _ in rows], texts, sent.value.hits(texts))

    return map_rows(docs, VERDICT, work)


def judged_by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same where the benchmark is large: fingerprints, then windows, meet in joins."""

    def prints(rows):
        for row, data in rows:
            texts = Texts([data])
            for kind in kinds:
                places, hashes = texts.fingerprints() if kind == GRAM else texts.runs(-kind)
                for p, h in zip(places.tolist(), hashes.astype(np.int64).tolist(), strict=True):
                    yield row, kind, p, h

    def wanted(rows):
        for item, data in rows:
            texts = Texts([data])
            n = len(texts.hashes)
            if 0 < n < WIDTH:
                yield item, -n, int(texts.runs(n)[1].astype(np.int64)[0])
            else:
                for h in texts.fingerprints()[1].astype(np.int64).tolist():
                    yield item, GRAM, h

    def windows(rows):
        for row, data, kinds, places in rows:
            texts = Texts([data])
            kinds, places = np.array(kinds), np.array(places, dtype=np.int64)
            for p in texts.around(places[kinds == GRAM]).tolist():
                yield row, p, WIDTH, texts.run_at(p, WIDTH)
            for kind, p in zip(kinds.tolist(), places.tolist(), strict=True):
                if kind < 0:
                    yield row, p, -kind, texts.run_at(p, -kind)

    def own_windows(rows):
        return ((words, item) for _, words, item in item_windows(rows))

    numbered = docs.select(
        F.struct("doc_id", F.xxhash64("data").alias("hash")).alias("row"), "doc_id", "data"
    ).withColumn("row", F.to_json("row"))
    sought = map_rows(items, "item string, kind int, hash long", wanted).select("kind", "hash").distinct()
    # At most ten values: full windows and the lengths of shorter items.
    kinds = sorted(r["kind"] for r in sought.select("kind").distinct().collect())
    found = map_rows(
        numbered.select("row", "data"), "row string, kind int, place long, hash long", prints
    ).join(sought, ["kind", "hash"], "left_semi")
    places = found.distinct().groupBy("row").agg(
        F.collect_list("kind").alias("kinds"), F.collect_list("place").alias("places")
    )
    once = numbered.select("row", "data").dropDuplicates(["row"])
    tried = map_rows(
        once.join(places, "row").select("row", "data", "kinds", "places"),
        "row string, place long, width int, words binary", windows,
    )
    kept = tried.join(map_rows(items, "words binary, item string", own_windows).distinct(), "words")
    hits = kept.groupBy("row").agg(
        F.collect_set(F.struct("place", "width", "item")).alias("hits")
    )

    def judge(rows):
        for doc, data, hits in rows:
            texts = Texts([data])
            yield from verdicts([doc], texts, [(h["place"], h["width"], {h["item"]}) for h in hits or []])

    return map_rows(
        numbered.join(hits, "row", "left").select("doc_id", "data", "hits"), VERDICT, judge
    )


def item_texts(
    benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text"
) -> tuple[DataFrame, int]:
    """Identifiers and texts of a benchmark's items, and their bytes."""
    items = benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), text_bytes(item_text).alias("data")
    )
    size = items.agg(F.sum(F.octet_length("data") + F.octet_length("item") + 64).alias("n")).first()["n"]
    return items, size or 0


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """Per document how many of its words lie in benchmark windows, and of which items.

    Words are runs of ASCII letters and digits and anything beyond ASCII, A-Z in lower case. A
    window is ten consecutive words of an item, or a shorter item as a whole. Every document word
    inside an occurrence of a window is hit. Null and empty texts have no words; items without
    words or without an identifier have no windows; items repeated under one identifier count
    once; other columns are ignored. Empty tables give no hits or no rows.

    A benchmark of up to ``index_bytes`` bytes of text is sent to every task and the documents are
    read once; a larger one meets them in joins, with the same result.

    Returns ``doc_id``, ``n_words``, ``n_hit``, ``items`` (identifiers as sorted strings).
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("data"))
    items, size = item_texts(benchmark, item_id, item_text)
    if size > index_bytes:
        return judged_by_join(slim, items)
    return judged_by_index(slim, Index([tuple(r) for r in items.collect()]))


def clean_rows(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """The rows without a word in a benchmark window, with all their columns.

    Each row is judged by its own text, as ``contaminated`` does. With a benchmark of up to
    ``index_bytes`` documents are judged and dropped in one pass.
    """
    items, size = item_texts(benchmark)
    if size > index_bytes:
        rows = keyed(docs, "row__key")
        verdict = contaminated(rows, benchmark, "row__key", text, index_bytes=index_bytes)
        return only(rows, "row__key", verdict.where("n_hit = 0").select("doc_id"))
    sent = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()]))

    def clean(held):
        hit = np.zeros(len(held), dtype=bool)
        texts = Texts(held)
        for place, _, _ in sent.value.hits(texts):
            hit[texts.text[place]] = True
        return ~hit

    return kept_rows(docs, clean, text)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``op7_decontamination``."""
    return contaminated(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(texts: dict, items: dict) -> dict:
    """The same by trying every window at every place; for tests on small tables."""
    wanted: dict[tuple, set] = {}
    for item, text in items.items():
        words = alphanumeric_words((text or "").encode())
        width = min(WIDTH, len(words))
        for i in range(len(words) - width + 1 if width else 0):
            wanted.setdefault(tuple(words[i : i + width]), set()).add(str(item))
    out = {}
    for doc, text in texts.items():
        words = alphanumeric_words((text or "").encode())
        hit, found = set(), set()
        for width in {len(w) for w in wanted}:
            for i in range(len(words) - width + 1):
                if names := wanted.get(tuple(words[i : i + width])):
                    hit.update(range(i, i + width))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(words), len(hit), len(found), digest, bool(hit))
    return out
