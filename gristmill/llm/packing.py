"""Packing of token sequences by multiway differencing.

Documents are tokenised once and cut into pieces of at most ``capacity`` tokens; what moves
afterwards is one narrow row per piece. Pieces are dealt into groups of bounded size, and each
group is partitioned into windows by the Karmarkar-Karp method: the two partial partitions with
the largest imbalance are merged, the largest windows of one meeting the smallest of the other,
until one partition is left. Should a window exceed the capacity, the group is partitioned anew
into more windows.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterable

import numpy as np
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import map_rows, pieces_for, ship_package, staged

CAPACITY = 1024
END = 0  # the id that closes every document

# Short pieces cut from a document's rest of three times their size: they fill what is left open.
SMALL = (96, 48, 24)

GROUP_PIECES = 800

PIECES = "doc_id long, doc_tokens long, start long, length int, ids_crc32 long"


# How byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Plain texts are Latin letters, digits, punctuation, blanks and line ends, in words up to a length.
PLAIN = bytes([0x0A, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
LONGEST = 1_000


def is_plain(text: str) -> bool:
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not data.translate(None, PLAIN) and max(map(len, data.split()), default=0) <= LONGEST


def byte_ranks(tokenizer: tokenizers.Tokenizer) -> dict[bytes, int]:
    """The vocabulary by bytes. It spells bytes as printable characters: those that are printable
    stand for themselves, the others follow from 256 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    hidden = [b for b in range(256) if b not in visible]
    spelled = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(spelled[c] for c in t): i for t, i in vocabulary.items() if t not in added}


class Encoder:
    """Token ids of texts, as little-endian 32-bit numbers.

    The same vocabulary can be read as merges or as byte ranks. Plain texts are encoded by ranks,
    which is four times as fast; scripts on whose classes of characters the two libraries might
    differ, special tokens and overlong words are left to the tokenizer itself.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.ranks = tiktoken.Encoding(
            "ranks", pat_str=SPLIT, mergeable_ranks=byte_ranks(self.tokenizer), special_tokens={}
        )

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per Python worker and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, text: str) -> np.ndarray:
        if "<|" not in text and is_plain(text):
            return self.ranks.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cuts(tokens: int, capacity: int, small: tuple[int, ...]) -> Iterable[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, a rest, and short ends of it."""
    start = 0
    while tokens - start >= capacity:
        yield start, capacity
        start += capacity
    for size in small:
        if tokens - start >= 3 * size:
            yield start, size
            start += size
    if tokens > start:
        yield start, tokens - start


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """Partition pieces into windows of nearly equal sums; gives the pieces of each window.

    A partial partition is a list of (sum, node), ascending, of at most ``windows`` entries; the
    entries it lacks are empty windows. A node is a piece, or two nodes that share a window.
    """
    joins: list[tuple[int, int]] = []

    def imbalance(partial):
        return partial[-1][0] - (partial[0][0] if len(partial) == windows else 0)

    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        meeting = max(0, len(a) + len(b) - windows)
        # Largest against smallest, where there are not enough empty windows for all.
        met = []
        for (x, left), (y, right) in zip(a[:meeting], b[:meeting][::-1], strict=True):
            joins.append((left, right))
            met.append((x + y, len(sizes) + len(joins) - 1))
        rest = b[meeting:]
        if not meeting and len(rest) == 1:
            insort(a, rest[0])
            merged = a
        else:
            merged = sorted(met + a[meeting:] + rest)
        made += 1
        heapq.heappush(heap, (-imbalance(merged), made, merged))
    out = []
    for _, top in heap[0][2] if heap else []:
        held, open_nodes = [], [top]
        while open_nodes:
            node = open_nodes.pop()
            if node < len(sizes):
                held.append(node)
            else:
                open_nodes += joins[node - len(sizes)]
        out.append(sorted(held))
    return out


def packed_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their number rises until none exceeds it."""
    total = sum(sizes)
    windows = max(1, -(-total // capacity))
    while True:
        out = differenced(sizes, windows)
        excess = max((sum(sizes[i] for i in w) for w in out), default=0) / capacity - 1
        if excess <= 0:
            return out
        windows += max(1, int(windows * excess / 4))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, small: tuple[int, ...]) -> DataFrame:
    def work(rows):
        encoder = Encoder.of(tokenizer)
        for doc, text in rows:
            data = np.append(encoder.encode(text or ""), END).astype("<u4").tobytes()
            tokens = len(data) // 4
            for start, length in cuts(tokens, capacity, small):
                crc = zlib.crc32(memoryview(data)[4 * start : 4 * (start + length)])
                yield doc, tokens, start, length, crc

    return map_rows(docs, PIECES, work)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
    small: tuple[int, ...] = SMALL,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Place every token of every document in one sequence of at most ``capacity`` tokens.

    A document is its text's ids (null: none) and a closing id. It is cut into pieces; each row of
    the result is one piece. Rows of the input that repeat are packed as often as they come. Other
    columns are ignored; an empty table gives an empty result.

    Returns ``doc_id``, ``start`` (ids of the document before the piece), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset`` within it.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = staged(pieces(slim, tokenizer, capacity, small), "pieces")
    groups = pieces_for(cut.where(F.col("length") < capacity).count(), group_pieces)
    # The staged rows do not change, so neither do their numbers; equal rows get different ones.
    row = F.monotonically_increasing_id()
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(row), F.lit(groups)))

    def place(key, rows):
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        sizes = rows["length"].to_numpy()
        short = np.flatnonzero(sizes < capacity)
        windows = [[int(i)] for i in np.flatnonzero(sizes >= capacity)]
        windows += [[int(short[i]) for i in w] for w in packed_group(sizes[short].tolist(), capacity)]
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for n, held in enumerate(windows):
            sequence[held] = (int(key[0]) << 32) + n
            offset[held] = np.cumsum([0, *sizes[held[:-1]]])
        return rows.assign(sequence_id=sequence, offset=offset).drop(columns="group")

    ship_package(docs.sparkSession)
    placed = dealt.groupBy("group").applyInPandas(place, PIECES + ", sequence_id long, offset long")
    return placed.select(
        "doc_id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
