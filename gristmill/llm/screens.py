"""Count-min screens: a fixed room of counters that tells which hashes can be repeated.

A hash is counted in one cell of each row. A cell never counts too little, so a hash whose
smallest cell stays below a threshold has certainly been seen less often; those above it may owe
that to others in the same cells. Only one bit a cell leaves the tasks: whether it reached the
threshold. With a threshold of one the same bits are a Bloom filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import MULTIPLIER, give_back, mix, ship_package, small_batches

ROWS = 2

# Cells that travel and are added up together.
PAGE = 1 << 16

# Bits of a row at most: two rows take 32 MB, whatever the number of hashes. A fuller screen lets more
# hashes pass, which costs their shuffle and changes no result.
MOST_BITS = 1 << 27

# Hashes that a task gathers before it packs them.
GATHERED = 1 << 18


def bits_for(n: int) -> int:
    """Cells of a row for a number of hashes: eight each, within the bound."""
    return int(min(MOST_BITS, max(PAGE, 1 << max(8 * n - 1, 1).bit_length())))


class Screen:
    """Bits of every row, and the test of hashes against them."""

    def __init__(self, bits: int, pages: dict[int, bytes]):
        self.bits = bits
        self.table = np.zeros(ROWS * bits // 8, dtype=np.uint8)
        for page, filled in pages.items():
            start = page * PAGE // 8
            self.table[start : start + PAGE // 8] = np.frombuffer(filled, dtype=np.uint8)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash (unsigned, 64 bits) reaches the threshold in all its cells."""
        good = np.ones(len(hashes), dtype=bool)
        for cells in cells_of(hashes, self.bits):
            good &= (self.table[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return good


def cells_of(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The cell of each hash in every row, numbered through all rows."""
    for row in range(ROWS):
        yield (mix(hashes * MULTIPLIER + np.uint64(row + 1)) & np.uint64(bits - 1)) + np.uint64(row * bits)


def own_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """The hashes in the only column of a batch."""
    return batch.column(0).drop_null().cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)


def screen(
    hashes: DataFrame,
    column: str | list[str],
    n: int,
    at_least: int,
    hashed: Callable[[pa.RecordBatch], np.ndarray] = own_hashes,
) -> Screen:
    """The screen of a column of 64-bit hashes of which there are about ``n``.

    Null hashes are left out; ``hashed`` makes them of other columns. It runs in the same Python
    worker, as a map of its own would keep a second one beside every task. Tasks send the cells they
    hit, two bytes each; the pages of bits, whose number is bounded by ``MOST_BITS``, are all that
    the driver gets.
    """
    bits = bits_for(n)

    def packed(found: np.ndarray) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(list(cells_of(found, bits))))
        wanted = np.ones(len(cells), dtype=bool)
        wanted[at_least:] = cells[at_least:] != cells[:-at_least]
        cells = cells[wanted]
        page = (cells >> np.uint64(16)).astype(np.int32)
        starts = np.flatnonzero(np.diff(page, prepend=-1))
        pages, parts = page[starts], np.split((cells & np.uint64(PAGE - 1)).astype(np.uint16), starts[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array(pages), pa.array([p.tobytes() for p in parts], type=pa.binary())],
            names=["page", "cells"],
        )

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(hashed(batch))
            size += len(held[-1])
            if size >= GATHERED:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield packed(np.concatenate(held))
        del held
        give_back()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by page; one page of counters is held at a time."""
        page, counts = None, None

        def bitmap() -> pa.RecordBatch:
            full = np.packbits(counts >= at_least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([page], type=pa.int32()), pa.array([full], type=pa.binary())], names=["page", "bits"]
            )

        for batch in batches:
            for number, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != page:
                    if page is not None:
                        yield bitmap()
                    page, counts = number, np.zeros(PAGE, dtype=np.int64)
                counts += np.bincount(np.frombuffer(cells, dtype=np.uint16), minlength=PAGE)
        if page is not None:
            yield bitmap()

    small_batches(hashes.sparkSession)
    ship_package(hashes.sparkSession)
    columns = [column] if isinstance(column, str) else column
    hits = hashes.select(*columns).mapInArrow(hit, "page int, cells binary")
    pages = hits.repartition("page").sortWithinPartitions("page").mapInArrow(added, "page int, bits binary")
    return Screen(bits, {row["page"]: bytes(row["bits"]) for row in pages.collect()})
