"""What several operators share: words, word hashes, staged tables, row-wise Arrow maps."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gristmill.session import free_scratch, scratch_path, ship_package, small_batches

# Words remembered per Python worker; beyond it the memory starts anew, which changes no result.
REMEMBERED = 300_000

# Bytes of the longest word that is remembered; longer ones are rare and worked out each time.
LONGEST_REMEMBERED = 64

# Rows of an Arrow batch that become Python objects at a time.
SLICE = 256

# Rows of a result that are Python objects at a time.
RESULT_ROWS = 4_096

# Odd constants of a 64-bit mixing step.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIXER = np.uint64(0xBF58476D1CE4E5B9)

# Bytes that part words of letters and digits, and upper case, for ``alphanumeric_words``.
FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)
LOWERED = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Remembered(dict):
    """A bounded memory of a pure function's values by bytes.

    A Python worker outlives the tasks of many stages, so it keeps one memory at a time: the first
    new word of another one frees it.
    """

    _in_use: Remembered | None = None

    def __init__(self, function: Callable, limit: int = REMEMBERED):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(key) > LONGEST_REMEMBERED:
            return self.function(key)
        if Remembered._in_use is not self:
            if Remembered._in_use is not None:
                Remembered._in_use.clear()
            Remembered._in_use = self
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


WORD_HASHES = Remembered(xxhash.xxh3_64_intdigest)


def blank_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; none in a null text."""
    return text.split() if text else []


def lowered_words(text: bytes | None) -> list[bytes]:
    """The same words with A-Z in lower case."""
    return text.translate(LOWERED).split() if text else []


def alphanumeric_words(text: bytes | None) -> list[bytes]:
    """Words of digits, letters and all beyond ASCII, with A-Z in lower case."""
    return text.translate(FOLDED).split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(WORD_HASHES.__getitem__, words)), dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * MIXER
    return values ^ (values >> np.uint64(27))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``width`` entries, built by joining blocks of doubling length."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    block, size = mix(words + np.uint64(seed * int(MULTIPLIER) % 2**64)), 1
    joined, done = None, 0
    while True:
        if width & size:
            tail = block[done : done + n]
            joined = tail if joined is None else mix(joined[:n] * MULTIPLIER + tail)
            done += size
        if size * 2 > width:
            return joined
        block = mix(block[:-size] * MULTIPLIER + block[size:])
        size *= 2


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of some concatenated lists begins, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared folder and read it back: lineage ends here.

    Whatever executors are lost later, the rows need not be worked out again.
    """
    path = scratch_path(df.sparkSession, label)
    STAGED.append((df.sparkSession.sparkContext.applicationId, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Tables written by ``staged`` and not yet freed, with the application they belong to.
STAGED: list[tuple[str, str]] = []


def free_staged(needed_by: DataFrame) -> None:
    """Delete all tables staged so far but those that a table still reads.

    For the start of a step whose input is all that is left to do with what was staged before.
    """
    spark = needed_by.sparkSession
    own = [x for x in STAGED if x[0] == spark.sparkContext.applicationId]
    read = "\n".join(needed_by.inputFiles()) if own else ""
    for app, path in own:
        if path.rpartition("/")[2] not in read:
            free_scratch(spark, path)
            STAGED.remove((app, path))


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """The rows with a number of their own; identifiers may be missing or repeated.

    Numbers depend on how rows are read, so they are written down before anything is judged by them.
    """
    if key in docs.columns:
        raise ValueError(f"a column is named {key} already")
    return staged(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


def only(docs: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose own number is among those in the only column of ``kept``, without it."""
    return docs.join(kept.toDF("kept__key"), F.col(key) == F.col("kept__key"), "left_semi").drop(key)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces_for(amount: float, each: float) -> int:
    """Into how many pieces of a given size an amount goes; at least one."""
    return max(1, math.ceil((amount or 0) / each))


def text_bytes(text: str = "text") -> F.Column:
    """A text as UTF-8 bytes, which Arrow hands over without decoding."""
    return F.col(text).cast("binary")


def give_back() -> None:
    """Return what the allocators hold unused: the worker waits for its next task beside other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_rows(
    df: DataFrame, schema: str, work: Callable[[list], Iterable[tuple]], batch_bytes: int = 1 << 22
) -> DataFrame:
    """Apply ``work`` to lists of rows (tuples), in blocks that hold a bounded amount of text.

    A block ends after ``batch_bytes`` of text and binary cells, so the memory of a task depends
    on neither the number nor the length of rows, but for a single row longer than a block. Results
    go back to Spark ``RESULT_ROWS`` at a time; ``work`` may yield as many as it likes.
    """
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    wide = [i for i, (_, kind) in enumerate(df.dtypes) if kind in ("string", "binary")]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
        )

    def results(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = iter(work(rows))
        while out := list(islice(found, RESULT_ROWS)):
            yield as_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.append(row)
                    size += 64 + sum(len(row[i]) for i in wide if row[i] is not None)
                    if size >= batch_bytes:
                        yield from results(held)
                        held, size = [], 0
        if held:
            yield from results(held)
        del held
        give_back()

    small_batches(df.sparkSession)
    ship_package(df.sparkSession)
    return df.mapInArrow(run, struct)


def kept_rows(
    df: DataFrame, keep: Callable[[list[bytes | None]], np.ndarray], text: str = "text", batch_bytes: int = 1 << 22
) -> DataFrame:
    """Rows whose text ``keep`` says yes to, with all their columns; judged and dropped in one pass.

    ``keep`` gets lists of texts with a bounded number of bytes. Nothing is shuffled.
    """
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i, value in enumerate(batch.column(place)):
                data = value.as_buffer()
                held.append(None if data is None else data.to_pybytes())
                size += 64 + len(held[-1] or b"")
                if size >= batch_bytes or i == batch.num_rows - 1:
                    found = batch.slice(first, len(held)).filter(pa.array(keep(held), type=pa.bool_()))
                    if found.num_rows:
                        yield found
                    first, held, size = i + 1, [], 0
        give_back()

    small_batches(df.sparkSession)
    ship_package(df.sparkSession)
    return df.mapInArrow(run, df.schema)
