"""Removal of repeated passages by difference-cover anchors.

A passage is a window of ``width`` consecutive words whose word sequence starts at two places.
Hashing every window would move one row per word. Instead only anchors move: shorter word runs
that begin where their position modulo a period lies in a difference cover. Whatever the shift
between two equal passages, some position inside both is covered in either document, so equal
passages always share an anchor at the same place. An anchor that occurs once rules out every
passage through it; only around anchors that occur twice are whole windows compared.

Words travel as hashes, packed: documents are dealt into chunks of a few megabytes, and each chunk
sends one cell per bucket of the hash space with its distinct hashes, sorted. A bucket answers
with one bit per hash, whether another chunk holds it too. A hash repeated inside a chunk is known
to be repeated there already and is sent once, so a passage in a third of all documents costs a
bucket one entry per chunk. Anchors (64 bits) only choose candidates; windows are decided by 96
bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import (
    MULTIPLIER,
    blank_words,
    mix,
    pieces_for,
    ship_package,
    shuffle_width,
    starts_of,
    text_bytes,
    window_hashes,
)

# A perfect difference set; every number modulo 21 is a difference of two of these.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)

CHUNK_BYTES = 1 << 22  # text per chunk
BUCKET_HASHES = 1 << 20  # hashes per bucket, about
BLOCK_WORDS = 1 << 14  # words hashed at a time, alone or in windows, which fit the processor's caches
LONG_WORD = 64  # bytes; words above are hashed one by one

# Whether a byte belongs to a word, as a table for ``bytes.translate``.
IN_WORD = bytes(b not in (0x20, *range(0x09, 0x0E)) for b in range(256))

SENT = "bucket int, chunk long, hashes binary"
ANSWERED = "step int, chunk long, bucket int, repeated binary"
ANCHORS, WINDOWS = 0, 1


def anchor_width(width: int) -> int:
    """The longest anchor that every pair of equal windows is sure to share."""
    if width < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words or more")
    return width - PERIOD + 1


def listed_words(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts end to end, their hashes, and where each text's begin."""
    joined = b" ".join([b"", *(t or b"" for t in texts), b""])
    word = np.frombuffer(joined.translate(IN_WORD), bool)
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    first, last = edges[::2], edges[1::2]
    # Without blanks only the words are left; they begin where the lengths add up to.
    data, places = np.frombuffer(joined, np.uint8)[word], starts_of(last - first)
    kind, offset = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
    words = pa.Array.from_buffers(kind, len(first), [None, pa.py_buffer(places.astype(offset)), pa.py_buffer(data)])
    begins = starts_of(np.array([len(t or b"") + 1 for t in texts]))
    return words, listed_hashes(data, places), np.searchsorted(first, begins + 1)


def listed_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of every word, from all its bytes, eight at a time; ``data`` has the words end to end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = np.diff(places).astype(np.uint64)
    for i in range(0, len(out), BLOCK_WORDS):
        block, begins = out[i : i + BLOCK_WORDS], places[i : i + BLOCK_WORDS]
        left = block.astype(np.int64)
        for w in np.flatnonzero(left > LONG_WORD):
            block[w] = xxhash.xxh3_64_intdigest(data[begins[w] : begins[w] + left[w]])
        some = np.flatnonzero(left <= LONG_WORD)
        found, at, left = block[some], begins[some], left[some]
        while len(some):
            bits = np.uint64(64) - 8 * np.minimum(left, 8).astype(np.uint64)
            found = mix(found * MULTIPLIER + (eights[at] << bits))
            block[some] = found
            on = np.flatnonzero(left > 8)
            some, found, at, left = some[on], found[on], at[on] + 8, left[on] - 8
    return out


def windows_in_blocks(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """``window_hashes`` of all words, with intermediate results for some of them at a time."""
    n = max(0, len(words) - width + 1)
    out = np.empty(n, np.uint64)
    for i in range(0, n, BLOCK_WORDS):
        j = min(n, i + BLOCK_WORDS)
        out[i:j] = window_hashes(words[i : j + width - 1], width, seed)
    return out


@dataclass
class Chunk:
    """The documents of a chunk in a fixed order, with their words and those' hashes end to end."""

    ids: list
    words: pa.Array
    hashes: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Chunk:
        held = sorted(
            zip(rows["doc_id"].tolist(), rows["data"].tolist(), strict=True),
            key=lambda r: (pd.isna(r[0]), 0 if pd.isna(r[0]) else int(r[0]), r[1] or b""),
        )
        return cls(
            [None if pd.isna(d) else int(d) for d, _ in held], *listed_words([data for _, data in held])
        )

    def inside(self, width: int) -> np.ndarray:
        """Whether a run of ``width`` words beginning here ends within the same document."""
        n = max(0, len(self.hashes) - width + 1)
        ends = np.repeat(self.starts[1:], np.diff(self.starts))
        return np.arange(n) + width <= ends[:n]

    def anchors(self, width: int) -> np.ndarray:
        """Places of all anchors."""
        covered = np.isin(np.arange(PERIOD), COVER)
        place = np.arange(len(self.hashes)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        inside = self.inside(width)
        return np.flatnonzero(inside & covered[place[: len(inside)] % PERIOD])


@dataclass
class Distinct:
    """Distinct hashes of a chunk in sorted order, and which entry each place has."""

    high: np.ndarray
    low: np.ndarray
    entry: np.ndarray
    several: np.ndarray

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> Distinct:
        order = np.argsort(high)
        h, lo = high[order], low[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        # Equal first halves with different second ones are next to never there, and then sorted by both.
        if np.any(~new[1:] & (lo[1:] != lo[:-1])):
            order = np.lexsort((low, high))
            h, lo = high[order], low[order]
            new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
        entry = np.empty(len(h), dtype=np.int64)
        entry[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return cls(h[first], lo[first], entry, np.diff(np.append(first, len(h))) > 1)

    def buckets(self, buckets: int) -> np.ndarray:
        """Ends of the buckets: equal shares of the range of hashes."""
        share = (self.high >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return np.searchsorted(share, np.arange(buckets + 1))

    def sent(self, chunk: int, buckets: int) -> pd.DataFrame:
        ends = self.buckets(buckets)
        rows = [
            (b, chunk, self.high[i:j].tobytes() + self.low[i:j].tobytes())
            for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True))
            if j > i
        ]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "hashes"])

    def repeated(self, answers: pd.DataFrame, step: int, buckets: int) -> np.ndarray:
        """For each place, whether its hash is in several places."""
        ends = self.buckets(buckets)
        found = self.several.copy()
        mine = answers[answers["step"] == step]
        for bucket, bits in zip(mine["bucket"], mine["repeated"], strict=True):
            i, j = ends[bucket], ends[bucket + 1]
            found[i:j] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
        return found[self.entry]


def anchor_hashes(chunk: Chunk, width: int) -> tuple[np.ndarray, Distinct]:
    places = chunk.anchors(anchor_width(width))
    hashes = windows_in_blocks(chunk.hashes, anchor_width(width))[places]
    return places, Distinct.of(hashes, np.zeros(len(hashes), np.uint32))


def window_places(chunk: Chunk, width: int, anchors: np.ndarray) -> np.ndarray:
    """Places of the windows that hold one of the given anchors."""
    n = len(chunk.hashes) + 1
    reach = np.bincount(np.maximum(anchors - (PERIOD - 1), 0), minlength=n) - np.bincount(anchors + 1, minlength=n)
    inside = chunk.inside(width)
    return np.flatnonzero(inside & (np.cumsum(reach)[: len(inside)] > 0))


def window_entries(chunk: Chunk, width: int, places: np.ndarray) -> Distinct:
    high = windows_in_blocks(chunk.hashes, width, seed=1)[places]
    low = windows_in_blocks(chunk.hashes, width, seed=2)[places]
    return Distinct.of(high, (low >> np.uint64(32)).astype(np.uint32))


def shared_between_chunks(step: int, rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's hashes in one bucket, whether another chunk has them too."""
    rows = rows.sort_values("chunk")
    cells = rows["hashes"].tolist()
    counts = np.array([len(c) // 12 for c in cells])
    high = np.concatenate([np.frombuffer(c, np.uint64, n) for c, n in zip(cells, counts, strict=True)])
    low = np.concatenate(
        [np.frombuffer(c, np.uint32, n, 8 * n) for c, n in zip(cells, counts, strict=True)]
    )
    entries = Distinct.of(high, low)
    found, starts = entries.several[entries.entry], starts_of(counts)
    bits = [
        np.packbits(found[i:j]).tobytes() if found[i:j].any() else None
        for i, j in zip(starts[:-1], starts[1:], strict=True)
    ]
    out = pd.DataFrame({"step": step, "chunk": rows["chunk"], "bucket": rows["bucket"], "repeated": bits})
    return out[out["repeated"].notna()]


def repeated_passages(
    docs: DataFrame, width: int = 35, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document its words, those inside repeated passages, and the digest of the rest.

    Words are runs of anything but ASCII white space. A window is ``width`` (at least 21) words of
    one document; every word inside a window whose word sequence also starts anywhere else, in the
    same document too, is removed. Windows are judged on the input as it stands.

    Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one
    space) and ``spans`` (half-open word ranges removed). One row per row of the input: null and
    empty texts have no words, repeated rows count as different places, other columns are ignored,
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    anchor_width(width)
    ship_package(spark)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("data"))
    size = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    chunks = pieces_for(size, CHUNK_BYTES)
    buckets = max(pieces_for(size / 6 * len(COVER) / PERIOD, BUCKET_HASHES), min(64, shuffle_width(spark)))
    chunked = slim.withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("data")), F.lit(chunks))
    )

    def send_anchors(key, rows):
        return anchor_hashes(Chunk.of(rows), width)[1].sent(key[0], buckets)

    def windows_of(rows, answers):
        chunk = Chunk.of(rows)
        places, entries = anchor_hashes(chunk, width)
        found = window_places(chunk, width, places[entries.repeated(answers, ANCHORS, buckets)])
        return chunk, found, window_entries(chunk, width, found)

    def send_windows(key, rows, answers):
        return windows_of(rows, answers)[2].sent(key[0], buckets)

    def finish(key, rows, answers):
        if not len(rows):
            return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "kept", "spans"])
        chunk, places, entries = windows_of(rows, answers)
        places = places[entries.repeated(answers, WINDOWS, buckets)]
        return pd.DataFrame(without_passages(chunk, places, width)).astype({"doc_id": "Int64"})

    def answer_anchors(rows):
        return shared_between_chunks(ANCHORS, rows)

    def answer_windows(rows):
        return shared_between_chunks(WINDOWS, rows)

    by_chunk = chunked.groupBy("chunk")
    anchors = by_chunk.applyInPandas(send_anchors, SENT).groupBy("bucket").applyInPandas(
        answer_anchors, ANSWERED
    )
    windows = (
        by_chunk.cogroup(anchors.groupBy("chunk"))
        .applyInPandas(send_windows, SENT)
        .groupBy("bucket")
        .applyInPandas(answer_windows, ANSWERED)
    )
    return by_chunk.cogroup(anchors.unionByName(windows).groupBy("chunk")).applyInPandas(
        finish, "doc_id long, n_words long, n_removed long, kept binary, spans array<array<int>>"
    )


def without_passages(chunk: Chunk, windows: np.ndarray, width: int) -> dict:
    """Cut the words under the given windows out of each document."""
    n = len(chunk.hashes)
    depth = np.bincount(windows, minlength=n + 1) - np.bincount(windows + width, minlength=n + 1)
    covered = np.cumsum(depth)[:n] > 0
    # Runs of covered words; one that goes on in the next document is two.
    opens, closes = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    opens[:n], closes[1:] = covered, covered
    inner = np.ones(n + 1, dtype=bool)
    inner[chunk.starts] = False
    edges = inner & opens & closes
    first, last = np.flatnonzero(opens & ~edges), np.flatnonzero(closes & ~edges)
    run_starts = np.searchsorted(first, chunk.starts)
    own = np.repeat(chunk.starts[:-1], np.diff(run_starts))
    runs = np.stack([first - own, last - own], axis=1).tolist()
    kept_starts = starts_of(~covered)[chunk.starts]
    kept = pa.LargeListArray.from_arrays(kept_starts, chunk.words.filter(pa.array(~covered)))
    n_words = np.diff(chunk.starts)
    return {
        "doc_id": chunk.ids,
        "n_words": n_words,
        "n_removed": n_words - np.diff(kept_starts),
        "kept": pc.binary_join(kept, b" ").to_pylist(),
        "spans": [runs[i:j] for i, j in zip(run_starts[:-1], run_starts[1:], strict=True)],
    }


def substring_report(docs: DataFrame) -> DataFrame:
    """The rows of ``op1_substring_dedup``: the kept words as a digest."""
    return repeated_passages(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def brute_force(texts: dict[int, str | None], width: int = 35) -> dict[int, tuple[int, int, str]]:
    """The same by looking up every window; for tests on small tables."""
    words = {d: blank_words((t or "").encode()) for d, t in texts.items()}
    seen: dict[tuple, int] = {}
    for w in words.values():
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            seen[key] = seen.get(key, 0) + 1
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out
